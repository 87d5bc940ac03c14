"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.catalog import models as m
from sessionlake.functions import hashing, jsonvalues as js, paths as pt, text as tx


def normalized_texts(spark, sf):
    """P5 on documents saved with foreign line ends and trailing blanks."""
    foreign = F.concat(F.lit(" \t"), F.replace("text", F.lit("\n"), F.lit(" \t\r\n")), F.lit("\r\n "))
    return m.table(spark, sf, "documents").select("doc_id", F.sha2(tx.normalize_text(foreign), 256).alias("text_hash"))


def canonical_props(spark, sf):
    """Canonical JSON and fingerprint of event properties."""
    padded = F.concat(F.lit(' {"z" : '), "props", F.lit(', "a":[ 1, {"y":null,"b":"'), "event_type", F.lit('"}]} '))
    return m.table(spark, sf, "events").select(
        "event_id", js.canonical_text(padded).alias("json"), hashing.block_fingerprint(js.canonical_text(F.col("props"))).alias("fingerprint"))


def session_identities(spark, sf):
    """P9."""
    return m.table(spark, sf, "pages").select("page_id", hashing.session_uid(F.lit("t"), F.lit("a"), F.col("url")).alias("uid"))


def project_dirs(spark, sf):
    """Folder names of short paths and of whole documents."""
    urls = m.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("part"), F.col("url").alias("path"))
    docs = m.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("part"), F.col("text").alias("path"))
    both = urls.unionByName(docs).withColumn("encoded", pt.encode_project_dir(F.col("path")))
    return both.select("id", "part", "encoded", F.when(F.col("part") == "page", pt.decode_project_dir(F.concat(F.lit("C--"), "encoded"))).alias("decoded"))


def relative_paths(spark, sf):
    """Safe and archive forms of page addresses."""
    rest = F.regexp_replace("url", "^https?://", "")
    odd = F.when(F.col("url").rlike("/fr/"), F.concat(F.lit("../"), rest)).when(F.col("url").rlike("/en/"), F.concat(F.lit("/./a\\"), rest)).otherwise(F.col("url"))
    return m.table(spark, sf, "pages").select(
        "page_id", pt.safe_relative_path(odd).alias("relative"), pt.safe_archive_name(odd).alias("archive"),
        pt.contained_in(F.lit("http://www"), F.col("url")).alias("inside"))


def suffixed_paths(spark, sf):
    """P23."""
    return m.table(spark, sf, "pages").select("page_id", pt.suffixed_path(F.concat(F.lit("/d.x/"), "page_id", F.lit(".jsonl")), F.concat(F.lit("from "), "url")).alias("path"))


def normalized_titles(spark, sf):
    """P13 over whole documents."""
    return m.table(spark, sf, "documents").select("doc_id", tx.normalize_title(F.col("text")).alias("title"))


def bare_ids(spark, sf):
    """P14, P18."""
    ids = F.concat(F.when(F.col("c_acctbal") > 0, "local_").otherwise(""), F.lit("local_"), "c_name")
    return m.table(spark, sf, "customer").select("c_custkey", tx.bare_id(ids).alias("bare"), tx.short_uuid(F.col("c_name")).alias("short"), tx.is_uuid(F.rpad("c_name", 36, "-")).alias("shaped"))


def sizes_and_ages(spark, sf):
    """Sizes, ages and times for display."""
    o = m.table(spark, sf, "orders")
    size = F.round(F.col("o_totalprice") * F.col("o_orderkey")).cast("long")
    now = F.lit("1998-08-01").cast("timestamp")
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp")) * F.when(F.col("o_orderstatus") == "P", -1).otherwise(1)
    return o.select("o_orderkey", tx.format_bytes(size).alias("size"), tx.relative_age(F.col("o_orderdate").cast("timestamp"), now).alias("age"),
                    F.date_format(tx.millis_to_timestamp(millis), "yyyy-MM-dd").alias("day"), F.size(tx.size_warnings(size, F.lit("truncated"))).cast("long").alias("n_warnings"))


def integrity_ranks(spark, sf):
    """O4, P19."""
    states = F.array(*[F.lit(s) for s in ("ok", "truncated", "empty", "damaged", "unreadable", "new")])
    state = F.get(states, F.length("o_orderpriority") % 6)
    return m.table(spark, sf, "orders").select("o_orderkey", tx.integrity_rank(state).cast("long").alias("rank"), tx.is_usable(state).alias("usable"))


def project_labels(spark, sf):
    """P20."""
    path = F.when(F.col("p_size") > 10, F.concat(F.lit("C:\\work\\"), "p_name", F.lit("/"))).when(F.col("p_size") > 5, "")
    key = tx.group_key(path, F.when(F.col("p_size") != 1, F.col("p_brand")))
    return m.table(spark, sf, "part").select("p_partkey", key.alias("key"), tx.group_label(key).alias("label"))


def newer_of_two(spark, sf):
    """Order date against last shipment."""
    shipped = m.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    o = m.table(spark, sf, "orders").join(shipped, "o_orderkey", "left")
    return o.select("o_orderkey", tx.pick_newer(F.col("o_orderdate").cast("timestamp"), F.col("shipped").cast("timestamp")).alias("newer"))


def text_lengths(spark, sf):
    """Characters as UTF-16 units, per language."""
    return m.table(spark, sf, "documents").groupBy("lang").agg(F.sum(tx.utf16_length(F.col("text"))).alias("chars"), F.count("*").alias("n_docs"))


def natural_keys(spark, sf):
    """O3: customers in natural order of odd names, as pairs that compare wrongly as text."""
    name = F.concat(F.lit("Item "), "c_custkey", F.lit(". Név"))
    c = m.table(spark, sf, "customer").select("c_custkey", tx.natural_key(name).alias("k"))
    following = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("k").alias("k2"))
    return c.join(following, "c_custkey").select("c_custkey", (F.col("k") < F.col("k2")).alias("in_order"))


QUERIES = {f.__name__: f for f in (
    normalized_texts, canonical_props, session_identities, project_dirs, relative_paths, suffixed_paths, normalized_titles, bare_ids,
    sizes_and_ages, integrity_ranks, project_labels, newer_of_two, text_lengths, natural_keys)}

_HASH = ("list_reduce(list_prepend(0::BIGINT, list_transform(string_split(path, ''), lambda x: unicode(x)::BIGINT)), "
         "lambda h, c: ((h * 31 + c + 2147483648) & 4294967295) - 2147483648)")
SQL = {
    "normalized_texts": f"SELECT doc_id, sha256({m.sql_norm('text')}) AS text_hash FROM documents",
    "canonical_props": """SELECT event_id, '{"a":[1,{"b":"' || event_type || '","y":null}],"z":' || replace(props, ' ', '') || '}' AS json,
        left(to_base64(unhex(sha1(replace(props, ' ', '')))), 16) AS fingerprint FROM events""",
    "session_identities": "SELECT page_id, 't|a|' || left(sha1(url), 12) AS uid FROM pages",
    "project_dirs": f"""WITH b AS (SELECT page_id AS id, 'page' AS part, url AS path FROM pages UNION ALL SELECT doc_id, 'doc', text FROM documents),
        e AS (SELECT *, regexp_replace(path, '[^A-Za-z0-9]', '-', 'g') AS d FROM b),
        f AS (SELECT id, part, CASE WHEN length(d) <= 200 THEN d ELSE left(d, 200) || '-' || lower(to_base(abs({_HASH}), 36)) END AS encoded FROM e)
        SELECT *, CASE WHEN part = 'page' THEN 'C:' || chr(92) || trim(replace(replace(encoded, '--', chr(92)), '-', ' ')) END AS decoded FROM f""",
    "relative_paths": r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS rest FROM pages),
        o AS (SELECT *, CASE WHEN url LIKE '%/fr/%' THEN 0 WHEN url LIKE '%/en/%' THEN 1 ELSE 2 END AS k FROM p)
        SELECT page_id, CASE k WHEN 1 THEN CASE WHEN contains(rest, ':') THEN NULL ELSE 'a/' || rtrim(regexp_replace(rest, '/+', '/', 'g'), '/') END END AS relative,
        CASE k WHEN 0 THEN rtrim(rest, '/') WHEN 1 THEN 'a/' || rtrim(rest, '/') ELSE rtrim(regexp_replace(url, '//+', '/', 'g'), '/') END AS archive,
        url LIKE 'http://www/%' AS inside FROM o""",
    "suffixed_paths": "SELECT page_id, '/d.x/' || page_id || '--from-' || regexp_replace(url, '[^A-Za-z0-9_-]', '-', 'g') || '.jsonl' AS path FROM pages",
    "normalized_titles": "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents",
    "bare_ids": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'local_' ELSE '' END || c_name AS bare, left(c_name, 8) AS short, false AS shaped FROM customer",
    "sizes_and_ages": """WITH o AS (SELECT *, round(o_totalprice * o_orderkey)::BIGINT AS s, epoch(TIMESTAMP '1998-08-01' - o_orderdate)::DOUBLE AS sec FROM orders)
        SELECT o_orderkey, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN format('{:.1f} KB', s / 1024.0) WHEN s < 1073741824 THEN format('{:.1f} MB', s / 1048576.0) ELSE format('{:.2f} GB', s / 1073741824.0) END AS size,
        CASE WHEN sec < 60 THEN 'just now' WHEN sec < 3600 THEN floor(sec / 60)::BIGINT || 'm ago' WHEN sec < 86400 THEN floor(sec / 3600)::BIGINT || 'h ago'
             WHEN sec < 604800 THEN floor(sec / 86400)::BIGINT || 'd ago' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS age,
        CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
        (1 + CASE WHEN s > 0 AND s < 2048 THEN 1 ELSE 0 END + CASE WHEN s > 268435456 THEN 1 ELSE 0 END)::BIGINT AS n_warnings FROM o""",
    "integrity_ranks": """SELECT o_orderkey, CASE length(o_orderpriority) % 6 WHEN 5 THEN 9 ELSE length(o_orderpriority) % 6 END::BIGINT AS rank, length(o_orderpriority) % 6 < 2 AS usable FROM orders""",
    "project_labels": r"""SELECT p_partkey, CASE WHEN p_size > 10 THEN 'C:\work\' || p_name || '/' WHEN p_size <> 1 THEN p_brand ELSE '(no project)' END AS key,
        CASE WHEN p_size > 10 THEN p_name WHEN p_size <> 1 THEN p_brand ELSE '(no project)' END AS label FROM part""",
    "newer_of_two": """SELECT o_orderkey, CASE WHEN s IS NULL OR o_orderdate > s THEN 'a' WHEN s > o_orderdate THEN 'b' END AS newer FROM orders LEFT JOIN
        (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "text_lengths": "SELECT lang, sum(length(text))::BIGINT AS chars, count(*) AS n_docs FROM documents GROUP BY 1",
    "natural_keys": "SELECT c_custkey, true AS in_order FROM customer WHERE c_custkey < (SELECT max(c_custkey) FROM customer)",
}
