"""Relinking agrees with choosing record by record, for many accounts at once."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sessionlake import fixed_values as fv
from sessionlake.plans import relink

TRANSCRIPTS = ("file_path string, session_id string, folder string, size_bytes long, mtime timestamp, custom_title string, "
               "ai_title string, cwd string, model string, integrity string")
RECORDS = ("index_path string, account_uuid string, kind string, cli_session_id string, title string, worktree_cwd string, "
           "origin_cwd string")


def norm(t):
    return re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()


def enc(p):
    return re.sub("[^A-Za-z0-9]", "-", p)


def sequential(records, transcripts, every):
    claimed = {(r["account_uuid"], r["cli_session_id"]) for r in records if r["cli_session_id"]}
    out = {}
    for r in sorted(records, key=lambda r: (r["account_uuid"], r["index_path"])):
        if r["cli_session_id"] and (r["worktree_cwd"] or r["origin_cwd"]):
            continue
        if r["cli_session_id"]:
            own = [t for t in transcripts if t["session_id"] == r["cli_session_id"]]
            if own:
                best = max(own, key=lambda t: (t["mtime"], t["size_bytes"], t["file_path"]))
                out[r["index_path"]] = (best["session_id"], best["file_path"], "own", 1, "strong")
                continue
        folders = {enc(c) for c in (r["worktree_cwd"], r["origin_cwd"]) if c}
        pool = [t for t in transcripts if (r["account_uuid"], t["session_id"]) not in claimed]
        for kind, source, exact in fv.TITLE_TIERS:
            def hit(t):
                if not r["title"]:
                    return False
                titles = every[t["file_path"]] if source == "former" else [t[f"{source}_title"]]
                return any(x and (x.strip() == r["title"].strip() if exact else norm(x) == norm(r["title"])) for x in titles)
            matches = [t for t in pool if hit(t)]
            if matches:
                break
        if not matches:
            out[r["index_path"]] = (None, None, None, 0, "none")
            continue
        rank = lambda t: (t["folder"] not in folders, -t["mtime"].timestamp(), -t["size_bytes"], t["file_path"])
        matches.sort(key=rank)
        best, inside = matches[0], [t for t in matches if t["folder"] in folders]
        n, n_in = len({t["session_id"] for t in matches}), len({t["session_id"] for t in inside})
        strong = n == 1 or (best["folder"] in folders and n_in == 1)
        claimed.add((r["account_uuid"], best["session_id"]))
        out[r["index_path"]] = (best["session_id"], best["file_path"], kind, n, "strong" if strong else "likely")
    return out


def world(seed, accounts):
    rng = random.Random(seed)
    names = ["Fix login", "fix-login", "Fix: login!", "Cart", "cart", "Search page", "", "Deploy"]
    dirs = ["/w/a", "/w/b", "/w/c", None]
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    transcripts, every = [], {}
    for i in range(60):
        d = rng.choice(dirs[:3])
        t = dict(file_path=f"/p/{i}.jsonl", session_id=f"s{rng.randrange(55)}", folder=enc(d), size_bytes=rng.randrange(5),
                 mtime=start + timedelta(hours=rng.randrange(12)), custom_title=rng.choice(names + [None] * 4) or None,
                 ai_title=rng.choice(names + [None] * 3) or None, cwd=d, model="m", integrity="ok")
        transcripts.append(t)
        every[t["file_path"]] = {x for x in (t["custom_title"], t["ai_title"], rng.choice(names), rng.choice(names)) if x}
    records = []
    for a in range(accounts):
        for i in range(rng.randrange(1, 40)):
            linked = rng.random() < 0.2
            records.append(dict(
                index_path=f"/i/{a:02d}/{i:03d}", account_uuid=f"acct{a:02d}", kind="session",
                cli_session_id=f"s{rng.randrange(60)}" if linked else None, title=rng.choice(names),
                worktree_cwd=rng.choice(dirs) if rng.random() < 0.9 else None, origin_cwd=rng.choice(dirs)))
    return records, transcripts, every


def frames(spark, records, transcripts, every):
    pick = lambda rows, ddl: [tuple(r[f.split()[0]] for f in ddl.split(", ")) for r in rows]
    r = spark.createDataFrame(pick(records, RECORDS), RECORDS)
    t = spark.createDataFrame(pick(transcripts, TRANSCRIPTS), TRANSCRIPTS)
    titles = spark.createDataFrame([(p, x) for p, xs in every.items() for x in xs], "file_path string, title string")
    return r, t, titles


@pytest.mark.parametrize("one_pass, accounts", [(2_000, 25), (12, 3), (0, 6)])
def test_assignment_equals_one_by_one_choosing(spark, one_pass, accounts):
    """Small accounts in one pass; accounts beyond the limit by deferred acceptance."""
    records, transcripts, every = world(7, accounts)
    want = sequential(records, transcripts, every)
    r, t, titles = frames(spark, records, transcripts, every)
    got = relink.scan_broken(r, t, titles, None, one_pass).collect()
    assert len(got) == len(want) > 10 * accounts
    for row in got:
        found = (row.best_session_id, row.best_path, row.match, row.n_matches, row.confidence)
        assert found == want[row.index_path], row.index_path
    assert sum(row.match is not None for row in got) > 8 * accounts


def wishes_of(spark, wishes, lists):
    """Frames of ``{(account, r): [list, …]}`` and ``{list: [session, …]}``."""
    keys = spark.createDataFrame([(a, r, n, name) for (a, r), names in wishes.items() for n, name in enumerate(names)],
                                 "account_uuid string, r_ord long, n int, list string")
    entries = spark.createDataFrame([(name, s, f"/p/{s}", k) for name, found in lists.items() for k, s in enumerate(found)],
                                    "list string, session_id string, file_path string, pos long")
    return keys, entries


def in_order(wishes, lists, claims=()):
    used, out = set(claims), {}
    for (a, r), names in sorted(wishes.items()):
        for n, name in enumerate(names):
            free = [s for s in lists.get(name, []) if (a, s) not in used]
            if free:
                used.add((a, free[0]))
                out[a, r] = (n, free[0])
                break
    return out


def accepted(spark, wishes, lists, claims=()):
    """What deferred acceptance gives, and its rounds; lists are merged as in ``assign``."""
    keys, entries = wishes_of(spark, wishes, lists)
    names = relink._same_lists(entries)
    order = keys.join(names, "list").groupBy("account_uuid", "r_ord").agg(
        F.array_sort(F.collect_list(F.struct("n", F.col("same").alias("list")))).alias("lists")).withColumn("level", F.lit(0))
    taken = spark.createDataFrame(list(claims), "account_uuid string, session_id string")
    done, rounds = relink.accept(order, entries, taken)
    return {(x.account_uuid, x.r_ord): (x.n, x.session_id) for x in done.collect()}, rounds


def test_alternating_records_take_a_handful_of_rounds(spark):
    """200 records ask in turn by the typed and by the derived title of the same
    transcripts; a second account clashes in 30 places that have nothing to do
    with each other."""
    shared = [f"s{k:03d}" for k in range(190)]
    lists = {"typed": shared, "derived": shared, "rest": [f"x{k}" for k in range(6)]}
    wishes = {("a", r): [("typed", "derived")[r % 2], "rest"] for r in range(200)}
    for k in range(30):
        lists[f"in{k}"], lists[f"any{k}"] = [f"c{k}"], [f"c{k}", f"d{k}"]
        wishes["b", 3 * k], wishes["b", 3 * k + 1], wishes["b", 3 * k + 2] = [f"any{k}"], [f"in{k}", f"any{k}"], [f"any{k}"]
    got, rounds = accepted(spark, wishes, lists, [("a", "s005"), ("b", "c7")])
    assert got == in_order(wishes, lists, [("a", "s005"), ("b", "c7")])
    assert len([1 for a, _r in got if a == "a"]) == 195
    assert rounds <= 6


@pytest.mark.parametrize("seed", range(2))
def test_acceptance_of_random_wishes_is_choosing_in_order(spark, seed):
    rng = random.Random(seed)
    lists = {f"l{k}": [s for s in (f"s{i:02d}" for i in range(25)) if rng.random() < 0.4] for k in range(7)}
    wishes = {(f"a{a}", r): rng.sample(sorted(lists), rng.randrange(1, 4)) for a in range(4) for r in range(18)}
    claims = {(f"a{rng.randrange(4)}", f"s{rng.randrange(25):02d}") for _ in range(12)}
    got, _rounds = accepted(spark, wishes, lists, claims)
    assert got == in_order(wishes, lists, claims)


def test_nobody_asks(spark):
    got, rounds = accepted(spark, {}, {"l": ["s"]})
    assert (got, rounds) == ({}, 0)


def test_repair_writes_only_what_is_missing(spark):
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    transcripts = [dict(file_path="/p/1.jsonl", session_id="s1", folder="-w-a", size_bytes=1, mtime=start, custom_title="T", ai_title=None,
                        cwd="/w/a", model="m", integrity="ok"),
                   dict(file_path="/p/2.jsonl", session_id="s2", folder="-w-a", size_bytes=1, mtime=start, custom_title="U", ai_title=None,
                        cwd="/w/u", model="m", integrity="ok")]
    base = dict(account_uuid="a", kind="session", cli_session_id=None, worktree_cwd="/w/x", origin_cwd=None)
    records = [dict(base, index_path="/i/1", title="T"), dict(base, index_path="/i/2", title="U", cli_session_id="s2", worktree_cwd=None),
               dict(base, index_path="/i/3", title="?")]
    r, t, titles = frames(spark, records, transcripts, {"/p/1.jsonl": {"T"}, "/p/2.jsonl": {"U"}})
    plan = relink.plan_repair(relink.scan_broken(r, t, titles))
    after, outcomes, backup = relink.apply_repair(plan, r, t)
    state = {x.index_path: (x.cli_session_id, x.worktree_cwd) for x in after.collect()}
    assert state == {"/i/1": ("s1", "/w/x"), "/i/2": ("s2", "/w/u"), "/i/3": (None, "/w/x")}
    assert {x.index_path: x.applied for x in outcomes.collect()} == {"/i/1": "repaired", "/i/2": "repaired", "/i/3": "blocked"}
    assert backup.count() == 2
    again, outcomes2, _ = relink.apply_repair(plan, after, t)
    assert {x.applied for x in outcomes2.where("kind = 'repair'").collect()} == {"skipped"}


def test_orphans_and_records_for_them(spark):
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    make = lambda i, **kw: dict(dict(file_path=f"/p/{i}.jsonl", session_id=f"s{i}", folder="f", size_bytes=1, mtime=start, custom_title="T",
                                     ai_title=None, cwd="/w", model="m", integrity="ok"), **kw)
    transcripts = [make(1), make(2), make(3, cwd=None), make(4, custom_title=None), make(5, integrity="damaged")]
    base = dict(kind="session", title="T", worktree_cwd="/w", origin_cwd=None)
    records = [dict(base, index_path="/i/1", account_uuid="a", cli_session_id="s1"), dict(base, index_path="/i/2", account_uuid="b", cli_session_id="s2")]
    r, t, _ = frames(spark, records, transcripts, {"/p/1.jsonl": {"T"}})
    t = t.withColumn("first_at", F.lit(None).cast("timestamp")).withColumn("last_at", F.lit(None).cast("timestamp"))
    orphans = relink.scan_orphans(t, r, "a")
    assert {x.session_id: x.elsewhere for x in orphans.collect()} == {"s2": True, "s3": False, "s4": False, "s5": False}
    plan = relink.plan_create_records(orphans, "a", "/i/a")
    got = {x.session_id: (x.kind, x.reason) for x in plan.collect()}
    assert got == {"s2": ("create", None), "s3": ("blocked", "no working directory"), "s4": ("blocked", "no title"),
                   "s5": ("blocked", "transcript is damaged")}


def test_titles_of_the_same_transcripts_share_a_list(spark):
    """A place is numbers, and there once for the typed title exact, loose and former."""
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    transcripts = [dict(file_path=f"/p/{k}.jsonl", session_id=f"s{k}", folder="-w-a", size_bytes=k, mtime=start, custom_title="T", ai_title=None,
                        cwd="/w/a", model="m", integrity="ok") for k in range(5)]
    records = [dict(index_path=f"/i/{k}", account_uuid="a", kind="session", cli_session_id=None, worktree_cwd="/w/a", origin_cwd=None, title="T")
               for k in range(3)]
    r, t, titles = frames(spark, records, transcripts, {f"/p/{k}.jsonl": {"T", " t"} for k in range(5)})
    keys = relink._list_keys(relink.broken_records(r).withColumn("r_ord", F.monotonically_increasing_id()))
    claims = spark.createDataFrame([("a", "s2")], "account_uuid string, session_id string")
    named, entries, held, files = relink._lists(keys, t, titles, claims)
    assert entries.count() == 10 and {d for _c, d in entries.dtypes} == {"bigint"}
    assert named.select("list").distinct().count() == 2
    assert entries.join(held, "session_id").count() == 2 and files.count() == 5
