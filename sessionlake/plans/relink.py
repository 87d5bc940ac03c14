"""Index records without a transcript, and transcripts without a record.

A broken record is matched by title.  Within an account a transcript goes to
one record, records choose in their order, each takes the best transcript that
is left.  Choosing is not done record by record: see ``assign``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions.jsonvalues import with_fields
from sessionlake.functions.paths import encode_project_dir
from sessionlake.functions.text import js_trim, normalize_title, parse_instant
from sessionlake.operators.listing import first_of, header_fields, last_of
from sessionlake.operators.positions import dense_position, running_total
from sessionlake.session import materialize, shared

STRONG, LIKELY, NONE = "strong", "likely", "none"


def describe_transcripts(lines: DataFrame, inventory: DataFrame):
    """Facts of every main transcript, and every title each one ever carried.

    Whole files are read, so nothing depends on where a row happens to be.
    """
    rows = header_fields(lines)
    instant = parse_instant(F.col("ts"))
    real = F.when(~F.startswith("model", F.lit("<")), F.col("model"))
    facts = rows.groupBy("file_path").agg(
        F.min(instant).alias("first_at"), F.max(instant).alias("last_at"),
        first_of("cwd").alias("cwd"), last_of(real).alias("model"),
        last_of("custom_title").alias("custom_title"), last_of("ai_title").alias("ai_title"),
    )
    titles = rows.select("file_path", F.explode(F.array("custom_title", "ai_title")).alias("title")).where(
        "title IS NOT NULL").distinct()
    main = inventory.where("kind = 'main'").select(
        "file_path", F.col("file_session_id").alias("session_id"), F.col("project_dir").alias("folder"), "size_bytes", "mtime"
    )
    return main.join(facts, "file_path", "left"), titles


def title_match(record_title: Column, custom: Column, ai: Column) -> Column:
    """Rank (0 best) at which a transcript's titles answer a record's, or null."""
    rank = F.lit(None).cast("int")
    for n, (kind, exact) in reversed(list(enumerate(fv.PAIR_TIERS))):
        other = custom if kind.startswith("custom") else ai
        same = (js_trim(record_title) == js_trim(other)) if exact else (normalize_title(record_title) == normalize_title(other))
        rank = F.when((record_title != "") & (other != "") & same, n).otherwise(rank)
    return rank


def broken_records(records: DataFrame, account: str | None = None) -> DataFrame:
    """Readable records without a transcript id or without any folder."""
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    pointer, folder = absent("cli_session_id"), absent("worktree_cwd") & absent("origin_cwd")
    found = records.where("kind = 'session'").where(pointer | folder)
    if account is not None:
        found = found.where(F.col("account_uuid") == account)
    return found.withColumn("missing_pointer", pointer).withColumn("missing_cwd", folder)


def _title_key(kind: str, exact: bool, title: Column) -> Column:
    return F.concat(F.lit(f"{kind}{'=' if exact else '~'}"), js_trim(title) if exact else normalize_title(title))


def _numbered(frame: DataFrame, order: list, out: str) -> DataFrame:
    """Adds an increasing number following a global sort; blocks of 4096 numbers
    never hold more than 4096 rows.  Written, because the numbers depend on how
    the sort was partitioned."""
    return materialize(frame.orderBy(*order).withColumn(out, F.monotonically_increasing_id()), "numbered")


def _list_keys(broken: DataFrame) -> DataFrame:
    """The lists a record goes through, best first: for each title tier the
    matches in its own folders, then all matches."""
    folders = F.array_sort(F.array_distinct(F.filter(F.array(
        *[F.when(F.col(c) != "", encode_project_dir(F.col(c))) for c in ("worktree_cwd", "origin_cwd")]), lambda f: f.isNotNull())))
    titled = broken.where("title <> ''").withColumn("_folders", folders)
    wishes = []
    for n, (_name, kind, exact) in enumerate(fv.TITLE_TIERS):
        key = _title_key(kind, exact, F.col("title"))
        inside = F.when(F.size("_folders") > 0, F.struct(F.lit(2 * n).alias("n"), key.alias("key"), F.col("_folders").alias("folders")))
        anywhere = F.struct(F.lit(2 * n + 1).alias("n"), key.alias("key"), F.array().cast("array<string>").alias("folders"))
        wishes += [inside, anywhere]
    return titled.select("account_uuid", "r_ord", F.inline(F.array_compact(F.array(*wishes))))


def _lists(keys: DataFrame, transcripts: DataFrame, titles: DataFrame, claims: DataFrame):
    """Transcripts of every list in order: latest edit, then size, then path.

    A list holds a session once, through its best file.  Places are many, so
    they hold numbers only, and titles that name the same transcripts (the typed
    one exact and loose, say) share their lists.  Returns ``keys`` with their
    lists, the places (``file_path``: number of the transcript), ``claims`` on
    numbered sessions, and path and session id behind a number."""
    number = F.monotonically_increasing_id()
    sessions = materialize(
        transcripts.select("session_id").where("session_id IS NOT NULL").distinct().withColumn("session", number), "sessions")
    ordered = _numbered(
        transcripts.select("file_path", "session_id", "folder", "mtime", "size_bytes", "custom_title", "ai_title").join(
            sessions, "session_id", "left"),
        [F.desc("mtime"), F.desc("size_bytes"), "file_path"], "t_ord")
    asked = materialize(keys.select("key").distinct().withColumn("title_no", number), "title-keys")
    # All titles of a transcript meet in its row: there a title counts once.
    every = ordered.join(titles.groupBy("file_path").agg(F.collect_set("title").alias("former")), "file_path", "left")
    found = []
    for _name, kind, exact in fv.TITLE_TIERS:
        if kind == "former":
            found.append(F.transform(F.coalesce("former", F.array().cast("array<string>")), lambda t: _title_key(kind, exact, t)))
        else:
            title = F.col(f"{kind}_title")
            found.append(F.array(F.when(title != "", _title_key(kind, exact, title))))
    keyed = every.select("t_ord", "session", "folder", F.explode(F.array_distinct(F.array_compact(F.concat(*found)))).alias("key"))
    keyed = materialize(keyed.join(asked, "key").drop("key"), "keyed")
    same = _same(keyed, "title_no", ["t_ord"])
    named = keys.join(asked, "key").join(same, "title_no").select("account_uuid", "r_ord", "n", F.col("same").alias("title_no"), "folders")
    # A list is a title's, or (negative) a title's within folders.
    within = materialize(named.where(F.size("folders") > 0).select("title_no", "folders").distinct().withColumn("list", -1 - number), "lists")
    keys = materialize(named.join(within, ["title_no", "folders"], "left").select(
        "account_uuid", "r_ord", "n", F.coalesce("list", "title_no").alias("list")), "list-keys")
    anywhere = keyed.join(same.where("title_no = same").select("title_no"), "title_no", "left_semi").select(
        F.col("title_no").alias("list"), "session", "t_ord")
    inside = within.select("list", "title_no", F.explode("folders").alias("folder")).join(keyed, ["title_no", "folder"]).select(
        "list", "session", "t_ord")
    once = anywhere.unionByName(inside).groupBy("list", "session").agg(F.min("t_ord").alias("t_ord"))
    placed = dense_position(shared(once, "title-lists"), ["list"], ["t_ord"], F.shiftright("t_ord", 12))
    entries = materialize(placed.select("list", F.col("session").alias("session_id"), F.col("t_ord").alias("file_path"), "pos"), "entries")
    claims = claims.join(sessions, "session_id").select("account_uuid", F.col("session").alias("session_id"))
    return keys, entries, shared(claims, "claims"), ordered.select(F.col("t_ord").alias("place_no"), "file_path", "session_id")


# Accounts with at most this many searching records are settled in one pass
# each; what they need is bounded by it.  Larger ones are settled in rounds.
ONE_PASS_RECORDS = 2_000
# Places fetched of a list beyond those its own records can need: transcripts
# may also go to records that reach them through another title.
ONE_PASS_SLACK = 100

_DONE = ["account_uuid", "r_ord", "n", "list", "session_id", "file_path"]


def _done_schema(entries: DataFrame) -> str:
    types = dict(entries.dtypes)
    return "account_uuid string, r_ord bigint, n int, " + ", ".join(f"{c} {types[c]}" for c in _DONE[3:])


def assign(keys: DataFrame, entries: DataFrame, claims: DataFrame, one_pass: int = ONE_PASS_RECORDS) -> DataFrame:
    """Gives each record the best transcript that records before it left.

    ``keys``: ``account_uuid, r_ord, n, list``; ``entries``: ``list,
    session_id, file_path, pos``; ``claims``: ``account_uuid, session_id``.
    Lists, sessions and files may be names or numbers.

    An account of bounded size is one small group.  A larger one, and what a
    bounded pass could not settle, goes through ``accept``.
    """
    names = _same_lists(entries)
    entries = entries.join(names.where("list = same").select("list"), "list", "left_semi")
    existing = keys.join(names, "list").select("account_uuid", "r_ord", "n", F.col("same").alias("list"))
    order = existing.groupBy("account_uuid", "r_ord").agg(F.array_sort(F.collect_list(F.struct("n", "list"))).alias("lists"))
    order = materialize(order.withColumn("level", F.lit(0)), "pending")
    taken = claims.select("account_uuid", "session_id").distinct()
    sizes = order.groupBy("account_uuid").agg(F.count("*").alias("_n"))
    small = sizes.where(F.col("_n") <= one_pass).select("account_uuid")
    bounded = order.join(small, "account_uuid", "left_semi")
    held = materialize(_held(bounded.select("account_uuid", F.inline("lists")), entries, taken), "held")
    final = materialize(_one_pass(bounded, entries, taken, held), "one-pass")
    # A pass stops where a list would have to be read further than was fetched.
    stuck = final.where("n < 0").select("account_uuid", F.col("r_ord").alias("_from"))
    final = final.where("n >= 0")
    left = order.join(small, "account_uuid", "left_anti").unionByName(
        order.join(stuck, "account_uuid").where("r_ord >= _from").drop("_from"))
    accepted, _rounds = accept(left, entries, taken.unionByName(final.select("account_uuid", "session_id")))
    return final.unionByName(accepted)


def _same_lists(entries: DataFrame) -> DataFrame:
    """One name (``same``) for all lists with the same places.

    Records that ask for a transcript by different titles, say the typed and the
    derived one, then stand in one queue.  Lists are equal if their lengths and
    three 64-bit sums over all places are."""
    return _same(entries, "list", ["session_id", "file_path", "pos"])


def _same(places: DataFrame, name: str, place: list[str]) -> DataFrame:
    """The smallest ``name`` (``same``) of those with the same places."""
    hashed = [F.xxhash64(*place, F.lit(n)) for n in range(3)]
    marks = places.groupBy(name).agg(
        F.count("*").alias("_n"), *[F.bit_xor(h).alias(f"_h{n}") for n, h in enumerate(hashed)])
    mark = ["_n", "_h0", "_h1", "_h2"]
    return materialize(
        marks.join(marks.groupBy(*mark).agg(F.min(name).alias("same")), mark).select(name, "same"), "same")


def accept(pending: DataFrame, entries: DataFrame, taken: DataFrame):
    """Deferred acceptance: what one-by-one choosing gives, and the rounds it took.

    ``pending``: ``account_uuid, r_ord, lists, level`` (``lists``: the record's
    lists, best first; ``level``: the one it stands at).  A transcript holds the
    earliest record that ever asked for it, tentatively: an earlier one may
    still come and send its holder on.  All transcripts agree which record comes
    first, so the outcome is that of choosing in order, whatever the order of
    the asking.

    The open records of a list ask at once, the k-th for the k-th transcript
    that no record before the first of them holds.  Whatever the k-th passes
    over is then held by an earlier record for good.  One whose rank exceeds
    what there is moves to its next list.  A title shared by a million records
    is one join on ranks; clashes anywhere in an account are settled at the same
    time.  Rounds grow with the longest chain of records that send each other
    on, not with the number of clashes.  An account without open records is
    finished and leaves.
    """
    here, whose = ["account_uuid", "list"], ["account_uuid", "session_id"]
    pending, held, finished, rounds = materialize(pending, "pending"), None, [], 0
    while not pending.isEmpty():
        at = F.get("lists", F.col("level"))
        asking = pending.select("*", at["list"].alias("list"), at["n"].alias("n"))
        free = _unheld(asking, entries, taken, held)
        ranked = dense_position(asking, here, ["r_ord"], F.shiftright("r_ord", 12), "rank")
        asked = ranked.join(free, [*here, "rank"], "left").drop("rank")
        met = asked if held is None else asked.unionByName(held)
        first = met.where("session_id IS NOT NULL").groupBy(*whose).agg(F.min("r_ord").alias("_first"))
        judged = materialize(met.join(first, whose, "left"), "judged")
        rounds += 1
        sent_on = judged.where("session_id IS NULL OR r_ord > _first").withColumn(
            "level", F.col("level") + F.when(F.col("session_id").isNull(), 1).otherwise(0))
        pending = sent_on.where(F.col("level") < F.size("lists")).select("account_uuid", "r_ord", "lists", "level")
        holders = judged.where("r_ord = _first").drop("_first")
        going_on = pending.select("account_uuid").distinct()
        finished.append(holders.join(going_on, "account_uuid", "left_anti"))
        held = holders.join(going_on, "account_uuid", "left_semi")
    done = pending.sparkSession.createDataFrame([], _done_schema(entries))
    for part in finished:
        done = done.unionByName(part.select(*_DONE))
    return done, rounds


def _unheld(asking: DataFrame, entries: DataFrame, taken: DataFrame, held: DataFrame | None) -> DataFrame:
    """Of each list in use the first transcripts, one per record asking, that
    neither a claim nor a record before the first one asking has."""
    here = ["account_uuid", "list"]
    standing = asking.groupBy(*here).agg(F.count("*").alias("_n"), F.min("r_ord").alias("_from"))
    gone = taken.select("account_uuid", "session_id", F.lit(-1).cast("long").alias("_by"))
    if held is not None:
        gone = gone.unionByName(held.select("account_uuid", "session_id", F.col("r_ord").alias("_by")))
    gone = gone.join(standing.select("account_uuid").distinct(), "account_uuid", "left_semi")
    gone = gone.join(entries.select("list", "session_id"), "session_id").join(standing, here).where("_by < _from").select(
        *here, "session_id").distinct()
    spent = gone.groupBy(*here).agg(F.count("*").alias("_c"))
    end = F.col("_n") + F.coalesce("_c", F.lit(0)) - 1
    places = standing.join(spent, here, "left").select(*here, F.explode(F.sequence(F.lit(0).cast("long"), end)).alias("pos"))
    free = places.join(entries, ["list", "pos"]).join(gone, [*here, "session_id"], "left_anti")
    return dense_position(free.select(*here, "pos", "session_id", "file_path"), here, ["pos"], F.shiftright("pos", 12), "rank").drop("pos")


def _held(current: DataFrame, entries: DataFrame, taken: DataFrame) -> DataFrame:
    """Sessions that are taken already, by the lists in use they stand in
    (``account_uuid, list`` per record)."""
    here = ["account_uuid", "list"]
    asked = taken.join(current.select("account_uuid").distinct(), "account_uuid", "left_semi")
    return entries.select("list", "session_id").join(asked, "session_id").join(current.select(*here).distinct(), here, "left_semi")


def _reach(current: DataFrame, entries: DataFrame, taken: DataFrame, held: DataFrame, slack: int = 0) -> DataFrame:
    """Free entries of the lists in use (``account_uuid, list`` per record), as
    far into each list as its records can need: one place per record and one
    per session that is taken already (``held``)."""
    here = ["account_uuid", "list"]
    standing = current.groupBy(*here).agg(F.count("*").alias("_n"))
    spent = held.groupBy(*here).agg(F.count("*").alias("_c"))
    reach = standing.join(spent, here, "left").withColumn("_end", F.col("_n") + F.coalesce("_c", F.lit(0)) + slack)
    places = reach.select(*here, "_n", "_end", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_end") - 1)).alias("pos"))
    free = places.join(entries, ["list", "pos"]).join(taken, ["account_uuid", "session_id"], "left_anti")
    return free.select(*here, "_n", "_end", "pos", "session_id", "file_path")


def _one_pass(order: DataFrame, entries: DataFrame, taken: DataFrame, held: DataFrame) -> DataFrame:
    wishes = order.select("account_uuid", "r_ord", F.inline("lists"))
    free = _reach(wishes, entries, taken, held, ONE_PASS_SLACK)
    # What claims leave of the places fetched is cut to what the group can need.
    free = dense_position(free, ["account_uuid", "list"], ["pos"], F.shiftright("pos", 12), "_rank")
    most = F.col("_n") + ONE_PASS_SLACK
    free = free.where(F.col("_rank") < most)
    sizes = entries.groupBy("list").agg(F.count("*").alias("_size"))
    offers = free.join(sizes, "list").select(
        "account_uuid", F.lit(None).cast("long").alias("r_ord"), F.lit(None).cast("int").alias("n"), "list", "pos",
        "session_id", "file_path", ((F.col("_end") < F.col("_size")) | (F.col("_rank") == most - 1)).alias("more"))
    # A list whose fetched part is all taken still has to say that it goes on.
    ends = _ends(wishes, held, sizes)
    return wishes.unionByName(offers, True).unionByName(ends, True).groupBy("account_uuid").applyInPandas(_choose, _done_schema(entries))


def _ends(wishes: DataFrame, held: DataFrame, sizes: DataFrame) -> DataFrame:
    here = ["account_uuid", "list"]
    standing = wishes.groupBy(*here).agg(F.count("*").alias("_n"))
    spent = held.groupBy(*here).agg(F.count("*").alias("_c"))
    reach = standing.join(spent, here, "left").join(sizes, "list")
    return reach.where(F.col("_n") + F.coalesce("_c", F.lit(0)) + ONE_PASS_SLACK < F.col("_size")).select(*here, F.lit(True).alias("more"))


def _choose(group: pd.DataFrame) -> pd.DataFrame:
    """Records of one account choose in order; the first that would need more
    of a list than is here is reported with ``n = -1`` and ends the pass."""
    endless = set(group.loc[group["more"].eq(True), "list"])
    offers: dict = {}
    found = group[group["session_id"].notna()].sort_values("pos")
    # Numbers beside nulls come as floats; these are below 2 ** 53.
    found = found.astype({c: "int64" for c in ("session_id", "file_path") if found[c].dtype.kind == "f"})
    for name, session, path in zip(found["list"], found["session_id"], found["file_path"]):
        offers.setdefault(name, []).append((session, path))
    used, at, out = set(), {}, []
    account = group["account_uuid"].iloc[0]
    asked = group[group["r_ord"].notna()].sort_values(["r_ord", "n"])
    for record, wishes in asked.groupby("r_ord", sort=True):
        for n, name in zip(wishes["n"], wishes["list"]):
            offered, place = offers.get(name, []), at.get(name, 0)
            while place < len(offered) and offered[place][0] in used:
                place += 1
            at[name] = place
            if place < len(offered):
                used.add(offered[place][0])
                out.append((account, int(record), int(n), name, *offered[place]))
                break
            if name in endless:
                out.append((account, int(record), -1, name, None, None))
                return pd.DataFrame(out, columns=_DONE)
    return pd.DataFrame(out, columns=_DONE)


def _left_at_turn(chosen: DataFrame, entries: DataFrame, claims: DataFrame, counts: dict[str, str]) -> DataFrame:
    """How many transcripts of a list were free when each record chose, for the
    list in each column of ``counts``."""
    asked = chosen.select("account_uuid", "r_ord", F.explode(F.array(*counts)).alias("list")).where("list IS NOT NULL")
    used = asked.select("account_uuid", "list").distinct()
    events = entries.select("list", "session_id").join(
        chosen.select("account_uuid", "session_id", "r_ord"), "session_id").join(used, ["account_uuid", "list"], "left_semi")
    timeline = asked.select("*", F.lit(0).alias("_taken")).unionByName(
        events.select("account_uuid", "list", "r_ord", F.lit(1).alias("_taken")))
    placed = dense_position(timeline, ["account_uuid", "list"], ["r_ord", "_taken"], F.shiftright("r_ord", 12))
    summed = running_total(placed, ["account_uuid", "list"], "pos", "_taken", "_spent").where("_taken = 0")
    total = entries.groupBy("list").agg(F.count("*").alias("_total"))
    held = _held(used, entries, claims).groupBy("account_uuid", "list").agg(F.count("*").alias("_held"))
    free = F.col("_total") - F.coalesce("_held", F.lit(0)) - F.col("_spent")
    counted = shared(summed.join(total, "list").join(held, ["account_uuid", "list"], "left").select(
        "account_uuid", "r_ord", "list", free.alias("_free")), "counted")
    for column, out in counts.items():
        part = counted.withColumnsRenamed({"list": column, "_free": out})
        chosen = chosen.join(part, ["account_uuid", "r_ord", column], "left")
    return chosen


def _claims(records: DataFrame) -> DataFrame:
    """Sessions that linked records of each account hold."""
    return records.where("kind = 'session' AND cli_session_id <> ''").select(
        "account_uuid", F.col("cli_session_id").alias("session_id")).distinct()


def scan_broken(
    records: DataFrame, transcripts: DataFrame, titles: DataFrame, account: str | None = None, one_pass: int = ONE_PASS_RECORDS
) -> DataFrame:
    """Broken records with the transcript each one probably points at.

    ``records``: index records including broken ones; ``transcripts`` and
    ``titles`` as from ``describe_transcripts``.  A record that still has its
    transcript id keeps it; only the folder is looked up there.
    """
    numbered = _numbered(broken_records(records, account), ["account_uuid", "index_path"], "r_ord")
    best_file = transcripts.groupBy("session_id").agg(F.max(F.struct("mtime", "size_bytes", "file_path")).alias("b"))
    own = numbered.where("NOT missing_pointer").join(
        best_file.select(F.col("session_id").alias("cli_session_id"), F.col("b.file_path").alias("file_path")), "cli_session_id"
    ).select("account_uuid", "r_ord", F.col("cli_session_id").alias("session_id"), "file_path")
    searching = numbered.join(own.select("r_ord"), "r_ord", "left_anti")
    keys = shared(_list_keys(searching), "list-keys")
    keys, entries, claims, files = _lists(keys, transcripts, titles, _claims(records))
    chosen = assign(keys, entries, claims, one_pass)
    # The lists behind the choice: all matches of its tier, and those in the
    # record's folders.
    tier = keys.select("account_uuid", "r_ord", F.floor(F.col("n") / 2).alias("_tier"),
                       F.when(F.col("n") % 2 == 1, F.col("list")).alias("_any"), F.when(F.col("n") % 2 == 0, F.col("list")).alias("_in"))
    tier = tier.groupBy("account_uuid", "r_ord", "_tier").agg(F.max("_any").alias("_any"), F.max("_in").alias("_in"))
    chosen = shared(chosen.withColumn("_tier", F.floor(F.col("n") / 2)).join(tier, ["account_uuid", "r_ord", "_tier"]), "chosen")
    counted = _left_at_turn(chosen, entries, claims, {"_any": "n_matches", "_in": "n_in_folder"})
    counted = counted.drop("session_id").withColumnRenamed("file_path", "place_no").join(files, "place_no")
    in_folder = F.col("n") % 2 == 0
    kinds = F.array(*[F.lit(name) for name, _k, _e in fv.TITLE_TIERS])
    found = counted.select(
        "account_uuid", "r_ord", "session_id", "file_path", F.get(kinds, F.col("_tier").cast("int")).alias("match"),
        in_folder.alias("in_folder"), "n_matches",
        F.when((F.col("n_matches") == 1) | (in_folder & (F.col("n_in_folder") == 1)), STRONG).otherwise(LIKELY).alias("confidence"),
    ).unionByName(own.select(
        "account_uuid", "r_ord", "session_id", "file_path", F.lit("own").alias("match"), F.lit(None).cast("boolean").alias("in_folder"),
        F.lit(1).cast("long").alias("n_matches"), F.lit(STRONG).alias("confidence")))
    facts = transcripts.select("file_path", F.col("cwd").alias("transcript_cwd"))
    joined = numbered.join(found, ["account_uuid", "r_ord"], "left").join(facts, "file_path", "left")
    return joined.select(
        "index_path", "account_uuid", "title", "worktree_cwd", "origin_cwd", "cli_session_id", "missing_pointer", "missing_cwd",
        F.col("session_id").alias("best_session_id"), F.col("file_path").alias("best_path"), "transcript_cwd", "match", "in_folder",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("confidence", F.lit(NONE)).alias("confidence"),
        F.when(F.col("session_id").isNotNull(), F.concat(F.lit("title match: "), "match"))
        .when(F.coalesce("title", F.lit("")) == "", "record has no title").otherwise("no free transcript has this title").alias("reason"),
    )


def title_candidates(records: DataFrame, transcripts: DataFrame, titles: DataFrame, limit: int = fv.CANDIDATES_SHOWN) -> DataFrame:
    """Up to ``limit`` transcripts per broken record in order of preference,
    before records compete: best tier that has any, own folder first.  What a
    linked record of the account holds already is no candidate."""
    numbered = _numbered(broken_records(records), ["account_uuid", "index_path"], "r_ord")
    keys = shared(_list_keys(numbered), "list-keys")
    keys, entries, claims, files = _lists(keys, transcripts, titles, _claims(records))
    here = ["account_uuid", "list"]
    used = keys.select(*here).distinct()
    free = _reach(used, entries, claims, materialize(_held(used, entries, claims), "held"), 2 * limit)
    first = W.partitionBy(*here).orderBy("pos")
    free = free.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= 2 * limit).select(
        *here, "pos", F.col("file_path").alias("place_no"))
    free = shared(free.join(files, "place_no").drop("place_no"), "free")
    alive = keys.join(free.select(*here).distinct(), here, "left_semi")
    best = alive.groupBy("r_ord").agg(F.floor(F.min("n") / 2).alias("_tier"))
    wanted = alive.join(best, "r_ord").where(F.floor(F.col("n") / 2) == F.col("_tier"))
    # The first places of both lists are enough for the first places overall.
    near = wanted.select("r_ord", "n", *here).join(free, here)
    once = near.groupBy("r_ord", "file_path", "session_id").agg(F.min(F.struct(F.col("n").alias("n"), F.col("pos").alias("pos"))).alias("k"))
    listed = once.groupBy("r_ord").agg(F.slice(F.array_sort(F.collect_list(F.struct("k", "session_id", "file_path"))), 1, limit).alias("c"))
    return numbered.select("index_path", "account_uuid", "r_ord").join(
        listed.select("r_ord", F.posexplode("c").alias("place", "c")), "r_ord").select(
        "index_path", "account_uuid", "place", F.col("c.session_id").alias("session_id"), F.col("c.file_path").alias("file_path"))


def plan_repair(scan: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Fields to fill in for each broken record, or why there are none.

    ``selected``: ``index_path`` of the records to repair, all by default.
    """
    wanted = scan if selected is None else scan.join(selected.select("index_path").distinct(), "index_path", "left_semi")
    found = F.col("best_session_id").isNotNull()
    return wanted.select(
        F.when(found, fv.REPAIR).otherwise(fv.BLOCKED).alias("kind"), "index_path", "account_uuid", "title",
        F.when(F.col("missing_pointer"), F.col("best_session_id")).alias("set_cli_session_id"),
        F.when(F.col("missing_cwd"), F.col("transcript_cwd")).alias("set_cwd"),
        F.col("best_path").alias("transcript"), "confidence", "reason",
    )


def apply_repair(plan: DataFrame, records: DataFrame, transcript_paths: DataFrame):
    """Records after the repair, outcomes, and the rows that changed (backup).

    Only fields that are still missing are written, and only while the
    transcript is still there.  Of a whole record (``record_json``) all other
    fields stay as they are.
    """
    there = transcript_paths.select(F.col("file_path").alias("transcript"), F.lit(True).alias("_there")).distinct()
    now = records.select("index_path", F.col("cli_session_id").alias("_cli"), F.col("worktree_cwd").alias("_cwd"))
    joined = plan.join(now, "index_path", "left").join(there, "transcript", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    cli = F.when(blank("_cli"), F.col("set_cli_session_id"))
    cwd = F.when(blank("_cwd"), F.col("set_cwd"))
    applied = (
        F.when(F.col("kind") != fv.REPAIR, "blocked")
        .when(cli.isNull() & cwd.isNull(), "skipped")
        .when(F.col("_there").isNull(), "skipped")
        .otherwise("repaired")
    )
    outcomes = joined.select("index_path", "kind", "title", "transcript", applied.alias("applied"),
                             F.when(applied == "repaired", cli).alias("cli_session_id"), F.when(applied == "repaired", cwd).alias("cwd"))
    changed = outcomes.where("applied = 'repaired'").select("index_path", F.col("cli_session_id").alias("_cli"), F.col("cwd").alias("_cwd"))
    after = records.join(changed, "index_path", "left").withColumn("cli_session_id", F.coalesce("_cli", "cli_session_id")).withColumn(
        "worktree_cwd", F.coalesce("_cwd", "worktree_cwd"))
    if "record_json" in records.columns:
        touched = F.col("_cli").isNotNull() | F.col("_cwd").isNotNull()
        after = after.withColumn("record_json", F.when(
            touched, with_fields(F.col("record_json"), {"cliSessionId": F.col("_cli"), "cwd": F.col("_cwd")})).otherwise(F.col("record_json")))
    after = after.select(*records.columns)
    return after, outcomes, records.join(changed, "index_path", "left_semi")


def scan_orphans(transcripts: DataFrame, records: DataFrame, account: str | None = None) -> DataFrame:
    """Transcripts no account lists, or that ``account`` does not list."""
    listed = records.where("kind = 'session' AND cli_session_id <> ''").select(F.col("cli_session_id").alias("session_id"), "account_uuid")
    anywhere = listed.select("session_id").distinct()
    here = anywhere if account is None else listed.where(F.col("account_uuid") == account).select("session_id").distinct()
    elsewhere = anywhere.withColumn("_listed", F.lit(True))
    return transcripts.join(here, "session_id", "left_anti").join(elsewhere, "session_id", "left").withColumn(
        "elsewhere", F.coalesce("_listed", F.lit(False))).drop("_listed").withColumn(
        "title", F.coalesce("custom_title", "ai_title")).withColumn(
        "title_source", F.when(F.col("custom_title").isNotNull(), "user").otherwise("auto"))


def plan_create_records(orphans: DataFrame, account: str, history_dir: str) -> DataFrame:
    """Records to write for orphans of an account.

    Refused without a working directory, without a title, or when the
    transcript is damaged.  The record id follows from transcript and account.
    """
    why = (
        F.when(F.coalesce("cwd", F.lit("")) == "", "no working directory")
        .when(F.coalesce("title", F.lit("")) == "", "no title")
        .when(F.col("integrity").isin(*fv.UNUSABLE), F.concat(F.lit("transcript is "), "integrity"))
    )
    digest = F.sha2(F.concat_ws("|", "file_path", F.lit(account)), 256)
    record_id = F.concat(F.lit("local_"), F.substring(digest, 1, 32))
    created = F.coalesce("first_at", "mtime", F.current_timestamp())
    # Fixed values of a new record.
    record = F.struct(
        record_id.alias("sessionId"), F.col("session_id").alias("cliSessionId"), F.col("cwd"), F.col("cwd").alias("originCwd"),
        "title", F.col("title_source").alias("titleSource"), F.unix_millis(created.cast("timestamp")).alias("createdAt"),
        F.unix_millis(F.coalesce("last_at", "mtime", created).cast("timestamp")).alias("lastActivityAt"), "model", F.lit("high").alias("effort"),
        F.lit(False).alias("isArchived"), F.lit("auto").alias("permissionMode"),
        F.lit("skip_all_permission_checks").alias("chromePermissionMode"),
        F.array().cast("array<string>").alias("alwaysAllowedReasons"), F.array().cast("array<string>").alias("sessionPermissionUpdates"),
        F.lit(True).alias("classifierSummaryEnabled"),
    )
    return orphans.select(
        F.when(why.isNull(), fv.CREATE).otherwise(fv.BLOCKED).alias("kind"), "session_id", "title", "file_path", "size_bytes",
        "elsewhere", F.when(why.isNull(), F.concat(F.lit(history_dir + "/"), record_id, F.lit(".json"))).alias("dest_path"),
        F.when(why.isNull(), F.to_json(record, {"ignoreNullFields": "false"})).alias("record_json"), why.alias("reason"),
    )


def apply_create(plan: DataFrame, transcript_paths: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcomes of creating records; existing files are never touched."""
    there = transcript_paths.select("file_path", F.lit(True).alias("_there")).distinct()
    taken = existing.select(F.col("index_path").alias("dest_path"), F.lit(True).alias("_taken")).distinct()
    joined = plan.join(there, "file_path", "left").join(taken, "dest_path", "left")
    return joined.withColumn("applied", F.when(F.col("kind") != fv.CREATE, "blocked").when(F.col("_there").isNull(), "skipped")
                             .when(F.col("_taken").isNotNull(), "failed").otherwise("created")).drop("_there", "_taken")
