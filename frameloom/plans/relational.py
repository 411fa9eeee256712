"""Queries over the star-schema tables: lookups, sets, guards, parsing, grouping; and the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.operators import aggregates as A
from frameloom.operators import governance as G
from frameloom.operators import joins as J
from frameloom.operators.sinks import per_value
from frameloom.plans.views import duck, view
from frameloom.session import scratch
from frameloom.sources import probes, scans
from frameloom.streaming import windows

R6 = lambda c: F.round(c, 6)
B = duck("boxes", "gts", "blobs")


def nations(spark, d):
    """J-1: N:1 lookups through two dimensions; a missing partner would raise."""
    c = view(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    rows = J.lookup(c, view(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), ["n_nationkey"], "raise")
    rows = J.lookup(rows, view(spark, d, "region"), ["r_regionkey"])
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


def lookup_default(spark, d):
    """J-2: left lookup with defaults."""
    dim = view(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_suppliers"))
    return J.lookup_or(view(spark, d, "nation").select("n_nationkey", "n_name"), dim, ["n_nationkey"], {"n_suppliers": 0})


def semi(spark, d):
    """J-3, SRC-21: rows whose key is in a set."""
    wanted = view(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return view(spark, d, "lineitem").join(wanted, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def only_in_one(spark, d):
    """J-4, SET-4: keys that only one side has."""
    a = view(spark, d, "documents").where("n_chars > 1000").select("doc_id")
    return J.only_in_one(a, view(spark, d, "labels").select("doc_id"), ["doc_id"])


def reconciled(spark, d):
    """J-16: counts of two sources side by side with signed differences."""
    a = view(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n"))
    b = view(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg((F.count("*") * 10).alias("n"))
    return J.reconcile(a, b, ["key"], "n")


def last_wins(spark, d):
    """SRC-9, J-5: one row per key, the last in order."""
    l = view(spark, d, "lines")
    return J.last_of(l, ["l_orderkey"], ["idx"]).select("l_orderkey", F.col("idx").cast("long").alias("idx"), "l_partkey")


def grid(spark, d):
    """J-14: every row of a dimension with a grid of thresholds."""
    rows = J.with_grid(view(spark, d, "part").select("p_partkey", "p_size"), at_least=[10, 20, 30, 40])
    return rows.groupBy("at_least").agg(F.count_if(F.col("p_size") >= F.col("at_least")).alias("n"))


def conditions(spark, d):
    """J-15: two conditions per row, merged where they coincide."""
    rows = J.conditions(view(spark, d, "part").select("p_partkey", "p_size"), F.col("p_size") % 5 == 0)
    return rows.groupBy("condition").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


def fan_out(spark, d):
    """J-17, SET-2: keyed union with merged tags, then the rows of one tag."""
    a = view(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("seed"), F.lit("positive").alias("label"))
    b = view(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(3).alias("seed"), F.lit("negative").alias("label"))
    rows = J.merged_keys(a, b, ["doc_id"], "seed", "label")
    return rows.where(F.array_contains("tags", 3)).select("doc_id", "label", F.array_join(F.col("tags").cast("array<string>"), "|").alias("seeds"))


def several(spark, d):
    """SET-6: groups in more than one partition."""
    b = view(spark, d, "boxes")
    return J.in_several(b, "scene", "split").select("scene", F.array_join("members", ",").alias("splits"))


def set_ops(spark, d):
    """SET-1, SET-3, SET-5: union, intersection and difference of keys."""
    a = view(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))
    b = view(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n("union", a.union(b).distinct()).union(n("intersect", a.intersect(b))).union(n("except", a.distinct().join(b, "k", "left_anti"))).union(n("bag", a.unionAll(b)))


def sums(spark, d):
    """A-1, A-5: counts, conditional counts and shares."""
    return A.counted(view(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity") > 25).withColumn("share", R6("share"))


def composite(spark, d):
    """A-6: composite-key counts and integer sums."""
    return view(spark, d, "lines").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("q").alias("q"))


def grouping(spark, d):
    """A-7: one pass over all rows and over each of two groupings."""
    return A.by_each(view(spark, d, "lines").withColumn("one", F.lit(1)), ["l_returnflag", "l_linestatus"], ["one"], {"n": F.count("*"), "q": F.sum("q")}).drop("one")


def percentiles(spark, d):
    """A-2: exact percentiles."""
    s = A.summary(view(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return s.select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in s.columns[2:]))


def spread(spark, d):
    """A-3, A-4: mean, median and sample deviation."""
    x = view(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), R6(F.avg("s_acctbal")).alias("mean"), R6(F.median("s_acctbal")).alias("median"), F.round(F.stddev_samp("s_acctbal"), 4).alias("sd"))
    return x


def limits(spark, d):
    """O-1, O-3: the dearest orders with a total order."""
    return view(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


def per_group(spark, d):
    """O-4: at most three rows per group, urgent ones first."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), "o_orderkey")
    return view(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey", F.col("k").cast("long").alias("k"))


def parsing(spark, d):
    """PRJ-3, PRJ-12, SRC-14: flags, tolerant integers, rates and zero guards."""
    p = view(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.when(F.col("p_size") % 3 == 0, "Yes").when(F.col("p_size") % 3 == 1, "1").otherwise("no"), F.lit(" ")).alias("flag"), F.when(F.col("p_size") % 4 == 0, "n/a").otherwise(F.concat(F.lit(" 0"), F.col("p_size").cast("string"))).alias("num"), F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_size") % 2).cast("string")).alias("rate"))
    return p.select("p_partkey", C.truthy(F.col("flag")).alias("flag"), C.tolerant_int(F.col("num")).alias("num"), C.rational(F.col("rate")).alias("rate"))


def names(spark, d):
    """§2.9: padded ids, stems, suffixes, prefixes and `or`-style defaults."""
    u = view(spark, d, "pages").select("page_id", "url")
    return u.select("page_id", C.padded_id("E", F.col("page_id"), 6).alias("strip_id"), C.file_stem(F.col("url")).alias("stem"), F.col("url").startswith("https").alias("secure"), C.or_else(F.col("page_id") % 3, F.lit(7)).cast("long").alias("default_7"))


def json_fields(spark, d):
    """SRC-11: values from JSON text."""
    e = view(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


def guarded(spark, d):
    """SRC-20, G-1, FLT-1: rows of named partitions behind the guard."""
    return G.split_rows(view(spark, d, "boxes"), [" Train", "val"]).groupBy("split").agg(F.count("*").alias("n"))


def checks(spark, d):
    """G-3: collected assertions with signed differences."""
    o, l = view(spark, d, "orders"), view(spark, d, "labels")
    parts = [G.check(o, "orders_keyed", F.count_distinct("o_orderkey"), F.count("*")), G.check(l, "one_toxic", F.count_if(F.col("toxic") == 1), 1.0), G.check(l, "labels_known", F.count_if(~F.col("quality").isin(0, 1)), 0.0, severity="note"), G.check(l, "toxic_share", F.count_if(F.col("toxic") == 1) / F.count("*"), 0.1, 0.05)]
    return G.all_checks(spark, parts).select("check_name", R6("measured").alias("measured"), R6("expected").alias("expected"), R6("diff").alias("diff"), "severity")


def tolerance(spark, d):
    """G-4: recomputed against recorded values."""
    got = view(spark, d, "lines").groupBy("l_returnflag").agg(F.sum("q").cast("double").alias("v"))
    # recorded: one value within the tolerance, one beyond it, one key lost and one that nothing computes
    off = F.when(F.col("l_returnflag") == "A", 0.25).when(F.col("l_returnflag") == "N", -3.0)
    want = view(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.floor("l_quantity")).cast("double").alias("v"))
    want = want.select(F.when(F.col("l_returnflag") == "R", "X").otherwise(F.col("l_returnflag")).alias("l_returnflag"), (F.col("v") + F.coalesce(off, F.lit(0.0))).alias("v"))
    return G.compared(got, want, ["l_returnflag"], "v", 0.5)


def set_equality(spark, d):
    """SET-4: rows that only one of two sets holds."""
    a = view(spark, d, "customer").select((F.col("c_custkey") + 10).alias("k"))
    return G.same_sets(a, view(spark, d, "orders").select(F.col("o_custkey").alias("k")))


def disagreements(spark, d):
    """G-7, SRC-14, SRC-15: two probes of every file side by side, the second as fallback, and whether their rates disagree."""
    t = view(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    rate = F.when(F.col("doc_id") % 5 == 0, "30000/1001").when(F.col("doc_id") % 5 == 1, "0/0").otherwise("25/1")
    first = t.select("path", rate.alias("rate"), F.when(F.col("doc_id") % 7 > 0, F.col("n_chars")).cast("long").alias("frames"))
    second = t.select("path", F.when(F.col("doc_id") % 5 == 0, "30/1").when(F.col("doc_id") % 5 == 2, "24/1").otherwise("25/1").alias("rate"), F.length("text").cast("long").alias("frames"))
    out = probes.inventory(first, second)
    return out.select("path", F.col("frames").cast("long").alias("frames"), *(R6(c).alias(c) for c in ("fps", "duration_s")), "disagree")


def pass_cost(spark, d):
    """A-37: seconds of a pass at known rates; unknown ones counted."""
    frames = view(spark, d, "boxes").groupBy("split", "resolution", "video").agg(F.count_distinct("frame").alias("n_frames"))
    rates = spark.createDataFrame([("160x120", 644.8)], "resolution string, rate double")
    return A.pass_cost(frames, rates, "resolution", ["split"]).withColumn("seconds", R6("seconds"))


def inference_cost(spark, d):
    """A-38: cost of an inference matrix per split."""
    arms = spark.createDataFrame([("a", 1.5e-4, 3), ("b", 1.25e-3, 3), ("c", 7.5e-3, 2)], "arm string, s_each double, seeds int").agg(F.sum(F.col("s_each") * F.col("seeds")).alias("s_all"))
    n = view(spark, d, "blobs").groupBy("split").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(arms)).select("split", "n", F.round(F.col("n") * F.col("s_all") / 3600, 8).alias("hours"))


def embedding_norms(spark, d):
    """§1.2 tensors: exploded components with their largest and smallest place."""
    e = view(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x"))
    best = F.min(F.struct((-F.col("x")).alias("o"), "at"))["at"]
    return e.groupBy("vec_id").agg(F.count("*").alias("n"), best.cast("long").alias("argmax"), F.max("x").alias("largest"))


def sniffed_lines(spark, d):
    """SRC-13: kinds of documents, label lines and JSON texts by their first line."""
    boxes = F.concat_ws(" ", "l_orderkey", F.lit(1), F.lit(2), F.lit(3), "l_quantity", F.lit(5), F.lit("a"))
    texts = view(spark, d, "documents").select("text").unionByName(view(spark, d, "lineitem").select(boxes.alias("text"))).unionByName(view(spark, d, "events").select(F.col("props").alias("text")))
    numbers = view(spark, d, "supplier").select(F.col("s_acctbal").cast("string").alias("text"))
    kind = scans.line_kind(scans.first_line(F.coalesce("text", F.lit(""))))
    return texts.unionByName(numbers).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def written_and_read(spark, d):
    """SNK-8: a table per seed, written once and read back seed by seed."""
    out = scratch(spark, "seeds")
    per_value(view(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("seed")), "seed", out)
    parts = [spark.read.parquet(f"{out}/seed={k}").agg(F.lit(k).alias("seed"), F.count("*").alias("n"), F.sum("o_orderkey").alias("total")) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rolling_stream(spark, d):
    """ST-2, ST-4: the rolling buffer as a stream over files, equal to window_totals."""
    rows = view(spark, d, "tracks").select(F.col("video").cast("string").alias("video"), "frame", F.col("event_id").cast("double").alias("value"))
    source, sink, check = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-check"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    done = windows.rolling_stream(stream, 8, idle_ms=None).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start()
    done.awaitTermination()
    out = spark.read.schema(windows.OUTPUT).parquet(sink)
    return out.select(F.col("video").cast("long").alias("video"), "centre", F.col("total").cast("long").alias("total"))


QUERIES = {
    "nation_lookup": (nations, "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"),
    "lookup_default": (lookup_default, "SELECT n_nationkey, n_name, coalesce(n_suppliers, 0) AS n_suppliers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY ALL) ON s_nationkey = n_nationkey"),
    "semi_join": (semi, "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL"),
    "only_in_one": (only_in_one, "WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 1000) SELECT doc_id, 'left only' AS side FROM a WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right only' AS side FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM a)"),
    "reconciliation": (reconciled, """WITH a AS (SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS key, count(*) * 10 AS n FROM supplier GROUP BY ALL)
      SELECT coalesce(a.key, b.key) AS key, a.n AS left_value, b.n AS right_value, coalesce(a.n, 0) - coalesce(b.n, 0) AS diff, CASE WHEN b.n IS NULL THEN 'left only' WHEN a.n IS NULL THEN 'right only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.key = b.key"""),
    "last_wins": (last_wins, f"{duck('lines')} SELECT l_orderkey, CAST(max(idx) AS bigint) AS idx, arg_max(l_partkey, idx) AS l_partkey FROM lines GROUP BY l_orderkey"),
    "threshold_grid": (grid, "SELECT at_least, count(*) FILTER (p_size >= at_least) AS n FROM part, (SELECT unnest([10, 20, 30, 40]) AS at_least) GROUP BY at_least"),
    "joint_conditions": (conditions, "WITH r AS (SELECT p_size, unnest(CASE WHEN p_size % 5 = 0 THEN ['AB'] ELSE ['A', 'B'] END) AS condition FROM part) SELECT condition, count(*) AS n, CAST(sum(p_size) AS bigint) AS total FROM r GROUP BY ALL"),
    "seed_fan_out": (fan_out, "SELECT doc_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label, CASE WHEN quality = 1 THEN '1|3' ELSE '3' END AS seeds FROM labels WHERE toxic = 1"),
    "split_overlap": (several, f"{B} SELECT scene, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT DISTINCT scene, split FROM boxes) GROUP BY scene HAVING count(*) > 1"),
    "set_operations": (set_ops, """WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT 'union' AS op, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n
      UNION ALL SELECT 'intersect', (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) UNION ALL SELECT 'except', (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) UNION ALL SELECT 'bag', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)"""),
    "flag_shares": (sums, "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > 25) AS flagged, round(count(*) FILTER (l_quantity > 25) / count(*), 6) AS share FROM lineitem GROUP BY ALL"),
    "composite_groups": (composite, f"{duck('lines')} SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(q) AS bigint) AS q FROM lines GROUP BY ALL"),
    "grouping_sets": (grouping, f"""{duck('lines')} SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'all' END AS group_type, coalesce(l_returnflag, l_linestatus, 'all') AS grp, count(*) AS n, CAST(sum(q) AS bigint) AS q FROM lines GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))"""),
    "price_percentiles": (percentiles, """SELECT l_returnflag, count(*) AS n, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max, round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
      round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY ALL"""),
    "balance_spread": (spread, "SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 6) AS mean, round(median(s_acctbal), 6) AS median, round(stddev_samp(s_acctbal), 4) AS sd FROM supplier GROUP BY ALL"),
    "top_orders": (limits, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "group_limit": (per_group, "SELECT o_custkey, o_orderkey, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey) AS k FROM orders) WHERE k <= 3"),
    "value_parsing": (parsing, "SELECT p_partkey, p_size % 3 < 2 AS flag, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS bigint) END AS num, CASE WHEN p_size % 2 = 1 THEN p_size::DOUBLE END AS rate FROM part"),
    "names_and_stems": (names, r"""SELECT page_id, 'E' || lpad(CAST(page_id AS varchar), 6, '0') AS strip_id, regexp_extract(url, '([^/]*?)(\.[^./]*)?$', 1) AS stem, starts_with(url, 'https') AS secure, CASE WHEN page_id % 3 = 0 THEN 7 ELSE page_id % 3 END AS default_7 FROM pages"""),
    "json_fields": (json_fields, "WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS bigint) AS k FROM events) SELECT event_type, count(k) AS n, CAST(sum(k) AS bigint) AS total, max(k) AS largest FROM e GROUP BY ALL"),
    "guarded_split": (guarded, f"{B} SELECT split, count(*) AS n FROM boxes WHERE split IN ('train', 'val') GROUP BY ALL"),
    "assertions": (checks, """WITH c AS (SELECT 'orders_keyed' AS check_name, count(DISTINCT o_orderkey)::DOUBLE AS measured, count(*)::DOUBLE AS expected, 0.0 AS tol, 'failure' AS sev FROM orders UNION ALL SELECT 'one_toxic', count(*) FILTER (toxic = 1), 1, 0, 'failure' FROM labels
      UNION ALL SELECT 'labels_known', count(*) FILTER (quality NOT IN (0, 1)), 0, 0, 'note' FROM labels UNION ALL SELECT 'toxic_share', count(*) FILTER (toxic = 1) / count(*), 0.1, 0.05, 'failure' FROM labels)
      SELECT check_name, round(measured, 6) AS measured, round(expected, 6) AS expected, round(measured - expected, 6) AS diff, CASE WHEN abs(measured - expected) <= tol THEN 'ok' ELSE sev END AS severity FROM c"""),
    "recorded_values": (tolerance, "WITH v AS (SELECT l_returnflag, sum(floor(l_quantity))::DOUBLE AS v FROM lineitem GROUP BY ALL) SELECT l_returnflag, v AS got, CASE l_returnflag WHEN 'A' THEN v + 0.25 WHEN 'N' THEN v - 3 END AS want, CASE l_returnflag WHEN 'A' THEN -0.25::DOUBLE WHEN 'N' THEN 3 END AS diff, l_returnflag = 'A' AS same FROM v UNION ALL SELECT 'X', NULL, v, NULL, false FROM v WHERE l_returnflag = 'R'"),
    "set_equality": (set_equality, "SELECT k, 'left' AS side FROM (SELECT c_custkey + 10 AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT k, 'right' FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey + 10 FROM customer)"),
    "disagreements": (disagreements, """WITH p AS (SELECT CAST(doc_id AS varchar) AS path, CASE doc_id % 5 WHEN 0 THEN 30000 / 1001::DOUBLE WHEN 1 THEN NULL ELSE 25 END AS a, CASE doc_id % 5 WHEN 0 THEN 30 WHEN 2 THEN 24 ELSE 25 END::DOUBLE AS b, CASE WHEN doc_id % 7 > 0 AND n_chars <> 0 THEN n_chars ELSE length(text) END AS frames FROM documents)
      SELECT path, CAST(frames AS bigint) AS frames, round(coalesce(a, b), 6) AS fps, round(frames / coalesce(a, b), 6) AS duration_s, coalesce(abs(a - b) > 0.01, false) AS disagree FROM p"""),
    "pass_cost": (pass_cost, f"""{B}, f AS (SELECT split, resolution, video, count(DISTINCT frame) AS n FROM boxes GROUP BY ALL) SELECT split, round(sum(CASE WHEN resolution = '160x120' THEN n / 644.8::DOUBLE END), 6) AS seconds, count(*) FILTER (resolution <> '160x120') AS n_unknown FROM f GROUP BY split"""),
    "inference_cost": (inference_cost, f"{B} SELECT split, count(*) AS n, round(count(*) * (1.5e-4 * 3 + 1.25e-3 * 3 + 7.5e-3 * 2) / 3600, 8) AS hours FROM blobs GROUP BY split"),
    "component_places": (embedding_norms, "SELECT vec_id, len(embedding)::BIGINT AS n, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS argmax, list_max(embedding) AS largest FROM embeddings"),
    "first_line_kinds": (sniffed_lines, r"""WITH t AS (SELECT coalesce(text, '') AS text FROM documents UNION ALL SELECT concat_ws(' ', l_orderkey, 1, 2, 3, l_quantity, 5, 'a') FROM lineitem UNION ALL SELECT props FROM events UNION ALL SELECT CAST(s_acctbal AS varchar) FROM supplier), l AS (SELECT trim(split_part(text, chr(10), 1)) AS line FROM t)
      SELECT CASE WHEN length(line) = 0 THEN 'empty' WHEN regexp_matches(line, '^\d+\s+\d+(\s|$)') AND len(regexp_split_to_array(line, '\s+')) = 2 + 5 * TRY_CAST(regexp_extract(line, '^\d+\s+(\d+)', 1) AS bigint) THEN 'boxes' WHEN regexp_matches(line, '^[-+0-9.eE\s]+$') THEN 'numbers'
        WHEN regexp_matches(line, '^[\[{]') THEN 'json' WHEN contains(line, ',') THEN 'table' ELSE 'text' END AS kind, count(*) AS n FROM l GROUP BY ALL"""),
    "partitioned_write": (written_and_read, "SELECT CAST(o_orderkey % 3 AS int) AS seed, count(*) AS n, CAST(sum(o_orderkey) AS bigint) AS total FROM orders GROUP BY ALL"),
    "rolling_stream": (rolling_stream, f"""{duck('tracks')} SELECT video, frame AS centre, CAST(total AS bigint) AS total FROM (SELECT video, frame, sum(event_id) OVER w AS total, count(*) OVER w AS n FROM tracks WINDOW w AS (PARTITION BY video ORDER BY frame RANGE BETWEEN 3 PRECEDING AND 4 FOLLOWING)) WHERE n = 8"""),
}
