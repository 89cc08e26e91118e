"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import scalars as H
from tidelake.plans.catalog import query
from tidelake.plans.tables import r6, table

_WP = "50 + 50 * (2 / (1 + exp(-0.00368208 * cp)) - 1)"
_CP = "(SELECT event_id, (value * 20 - 500)::INT AS cp, CASE WHEN event_id % 50 = 0 THEN (event_id % 3)::INT - 1 END AS mate FROM events)"


@query("h1_h3_win_probability", f"WITH c AS (SELECT event_id, CASE WHEN mate > 0 THEN 10000 WHEN mate <= 0 THEN -10000 ELSE greatest(-10000, least(10000, cp)) END AS cp FROM {_CP}) SELECT event_id, cp::INT AS cp, round({_WP}, 6) AS wp, round(100 - ({_WP}), 6) AS flipped FROM c")
def h1(spark, sf):
    # Half to even, as the other engine rounds when it casts to whole numbers.
    rows = table(spark, sf, "events").select("event_id", F.rint(F.col("value") * 20 - 500).cast("int").alias("raw"), F.when(F.col("event_id") % 50 == 0, (F.col("event_id") % 3).cast("int") - 1).alias("mate"))
    rows = rows.withColumn("cp", H.pov_cp(F.col("raw"), F.col("mate")).cast("int"))
    return rows.select("event_id", "cp", r6(H.wp_from_cp(F.col("cp"))).alias("wp"), r6(H.flipped(H.wp_from_cp(F.col("cp")))).alias("flipped"))


@query("h4_h6_names_and_tokens", "SELECT p_partkey, trim(regexp_replace(lower(replace(p_name || ',  X', ',', ' ')), '\\s+', ' ', 'g')) AS name, len(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda t: len(t) > 0))) AS tokens FROM part")
def h4(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", H.normalise_name(F.concat("p_name", F.lit(",  X"))).alias("name"), F.size(H.token_set(F.concat_ws(" ", "p_name", "p_type"))).alias("tokens"))


@query("h5_fold_marks", f"SELECT doc_id, translate(text, '{H._FOLD_FROM}', '{H._FOLD_TO}') AS folded FROM documents")
def h5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", H.fold_marks(F.col("text")).alias("folded"))


_TITLES = "(SELECT s_suppkey, (ARRAY['GM', 'WGM', ' im ', 'wfm', 'XX'])[(s_suppkey % 5)::INT + 1] AS title, (ARRAY['F', 'M', NULL])[(s_suppkey % 3)::INT + 1] AS sex FROM supplier)"


@query("h7_h8_titles", f"WITH t AS (SELECT s_suppkey, CASE WHEN upper(trim(title)) IN ('WGM', 'WIM', 'WFM', 'WCM', 'WNM') THEN 'womens' WHEN upper(trim(title)) IN ('GM', 'IM', 'FM', 'CM', 'NM') THEN 'open' ELSE 'other' END AS class, sex FROM {_TITLES}) SELECT s_suppkey, class, CASE WHEN class = 'womens' OR sex = 'F' THEN 'female' WHEN sex = 'M' THEN 'male' ELSE 'unknown' END AS gender FROM t")
def h7(spark, sf):
    k = F.col("s_suppkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    rows = table(spark, sf, "supplier").select("s_suppkey", pick(["GM", "WGM", " im ", "wfm", "XX"]).alias("title"), pick(["F", "M", None]).alias("sex"))
    return rows.select("s_suppkey", H.title_class(F.col("title")).alias("class"), H.gender(F.col("title"), F.col("sex")).alias("gender"))


@query("h9_candidate_score", "SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 4 ELSE 0 END + CASE WHEN c_nationkey % 4 = 1 THEN 2 ELSE 0 END + CASE WHEN c_nationkey % 4 = 2 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS score FROM customer")
def h9(spark, sf):
    t = (F.col("c_nationkey") % 4).cast("string")
    return table(spark, sf, "customer").select("c_custkey", H.candidate_score(t, F.lit("0"), F.lit("1"), F.lit("2"), F.col("c_custkey") % 2 == 0).alias("score"))


@query("h10_literal_map", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'AFR' WHEN 1 THEN 'AME' WHEN 2 THEN 'ASI' END AS code FROM nation")
def h10(spark, sf):
    codes = F.create_map(*[F.lit(x) for x in (0, "AFR", 1, "AME", 2, "ASI")])
    return table(spark, sf, "nation").select("n_nationkey", F.try_element_at(codes, F.col("n_regionkey")).alias("code"))


@query("h11_h12_urls", "SELECT page_id, list_extract(string_split(rtrim(url, '/'), '/'), -1) AS last, CASE WHEN regexp_matches(list_extract(string_split(rtrim(url, '/'), '/'), -1), '^[0-9]+$') THEN list_extract(string_split(rtrim(url, '/'), '/'), -1)::INT END AS number FROM pages")
def h11(spark, sf):
    last = H.last_segment(F.col("url"))
    return table(spark, sf, "pages").select("page_id", last.alias("last"), H.digits_or_null(last).alias("number"))


_TC = "(SELECT p_partkey, (ARRAY['180', '60+1', '600+5', '1/1209600', '', 'abc', '180+2', '1800+30'])[(p_partkey % 8)::INT + 1] AS tc FROM part)"


@query("h13_h14_time_controls", f"WITH t AS (SELECT p_partkey, tc, CASE WHEN contains(tc, '/') THEN NULL ELSE TRY_CAST(split_part(tc, '+', 1) AS DOUBLE) END AS base, coalesce(TRY_CAST(split_part(tc, '+', 2) AS DOUBLE), 0) AS inc FROM {_TC}) SELECT p_partkey, base, CASE WHEN base IS NOT NULL THEN inc END AS inc, CASE WHEN NOT contains(tc, '+') OR base IS NULL THEN 'unknown' WHEN base + 40 * inc < 180 THEN 'bullet' WHEN base + 40 * inc < 480 THEN 'blitz' WHEN base + 40 * inc < 1500 THEN 'rapid' ELSE 'classical' END AS class FROM t")
def h13(spark, sf):
    tc = F.element_at(F.array(*[F.lit(x) for x in ("180", "60+1", "600+5", "1/1209600", "", "abc", "180+2", "1800+30")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", tc.alias("tc")).select("p_partkey", H.time_control(F.col("tc"))["base"].alias("base"), H.time_control(F.col("tc"))["inc"].alias("inc"), H.time_class(F.col("tc")).alias("class"))


@query("h15_month_index", "SELECT DISTINCT strftime(o_orderdate, '%Y/%m') AS month, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS at FROM orders")
def h15(spark, sf):
    month = F.date_format("o_orderdate", "yyyy/MM")
    return table(spark, sf, "orders").select(month.alias("month")).distinct().select("month", H.month_index(F.col("month")).alias("at"))


@query("h16_digests", "SELECT c_custkey, lpad(('0x' || right(md5(c_name), 1))::INT::VARCHAR, 2, '0') AS bucket, substr(md5(c_name), 1, 16) AS short, sha256(c_name) AS sha FROM customer")
def h16(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", H.md5_bucket(F.col("c_name")).alias("bucket"), F.substring(F.md5("c_name"), 1, 16).alias("short"), F.sha2("c_name", 256).alias("sha"))


@query("h17_h18_results", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 2 = 0 THEN CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.0 ELSE 0.5 END ELSE 1 - CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.0 ELSE 0.5 END END::DOUBLE AS result, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_quantity / l_discount, 4) END AS fraction FROM lineitem")
def h17(spark, sf):
    return _results(table(spark, sf, "lineitem"))


def _results(lines):
    result = F.when(F.col("l_returnflag") == "A", "1-0").when(F.col("l_returnflag") == "R", "0-1").otherwise("1/2-1/2")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", H.result_for_side(result, F.col("l_partkey") % 2 == 0).alias("result"), F.round(H.clock_fraction(F.col("l_quantity"), F.col("l_discount")), 4).alias("fraction"))


@query("h19_h21_numbers", "SELECT p_partkey, round(ln(p_retailprice), 6) AS l, round(sqrt(p_retailprice), 6) AS s, sign(p_size - 25)::DOUBLE AS sg, floor(p_retailprice / 7)::BIGINT AS f, round(greatest(0, p_size - 25), 1)::DOUBLE AS pos, round(10 + (90 - 10) * (p_size - 1) / 49.0, 6)::DOUBLE AS mid FROM part")
def h19(spark, sf):
    size = F.col("p_size")
    mid = H.interpolated(size.cast("double"), F.lit(1.0), F.lit(10.0), F.lit(50.0), F.lit(90.0))
    return table(spark, sf, "part").select("p_partkey", r6(F.ln("p_retailprice")).alias("l"), r6(F.sqrt("p_retailprice")).alias("s"), F.signum(size - 25).alias("sg"), F.floor(F.col("p_retailprice") / 7).alias("f"), F.round(F.greatest(F.lit(0), size - 25).cast("double"), 1).alias("pos"), r6(mid).alias("mid"))


@query("h22_json_get", "SELECT event_id, coalesce((props::JSON ->> '$.k')::INT, -1) AS k, coalesce(props::JSON ->> '$.missing', 'none') AS missing FROM events")
def h22(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("h23_h30_formats", """SELECT s_suppkey, replace(printf('%+.2f', s_acctbal), '-', '−') AS signed, replace(printf('[%+.2f, %+.2f]', s_acctbal - 10, s_acctbal + 10), '-', '−') AS ci, regexp_replace(printf('%.2g', s_suppkey / 2003.0::DOUBLE), '^0+', '') AS p, regexp_replace(printf('%.2g', s_suppkey / 200300000.0::DOUBLE), '^0+', '') AS tiny, printf('%.1f%%', 100 * s_suppkey / 2003.0::DOUBLE) AS pct,
split_part(printf('%.1e', s_suppkey / 3e20::DOUBLE), 'e', 1) || ' × 10' || translate(split_part(printf('%.1e', s_suppkey / 3e20::DOUBLE), 'e', 2)::INT::VARCHAR, '0123456789-', '⁰¹²³⁴⁵⁶⁷⁸⁹⁻') AS sci, CASE WHEN s_suppkey / 2003.0 < 0.001 THEN '***' WHEN s_suppkey / 2003.0 < 0.01 THEN '**' WHEN s_suppkey / 2003.0 < 0.05 THEN '*' ELSE '' END AS stars FROM supplier""")
def h23(spark, sf):
    b, p = F.col("s_acctbal"), F.col("s_suppkey") / 2003.0
    return table(spark, sf, "supplier").select("s_suppkey", H.signed(b, 2).alias("signed"), H.interval_text(b - 10, b + 10, 2).alias("ci"), H.p_text(p).alias("p"), H.p_text(F.col("s_suppkey") / F.lit(200300000.0)).alias("tiny"), H.percent(p, 1).alias("pct"), H.scientific(F.col("s_suppkey") / F.lit(3e20), 2).alias("sci"), H.stars(p).alias("stars"))


@query("h24_h26_lines", "WITH l AS (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity DESC, l_partkey) AS w FROM lineitem GROUP BY 1) SELECT l_orderkey, w[1] AS first, w[-1] AS last, list_max(w) - list_min(w) AS steep, round(list_stddev_pop(w), 6) AS sd, list_position(w, w[-1]) AS place FROM l")
def h24(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity"), False).alias("w"))
    s = H.line_stats(F.col("w"))
    return g.select("l_orderkey", s["first"].alias("first"), s["last"].alias("last"), s["steep"].alias("steep"), r6(s["sd"]).alias("sd"), F.array_position("w", s["last"]).alias("place"))


@query("g31_verdict", "SELECT event_type, CASE WHEN avg(value) - 2 * stddev_samp(value) / sqrt(count(*)) > 50 THEN 'positive' WHEN avg(value) + 2 * stddev_samp(value) / sqrt(count(*)) < 50 THEN 'negative' ELSE 'includes zero' END AS verdict FROM events GROUP BY 1")
def g31(spark, sf):
    half = 2 * F.stddev_samp("value") / F.sqrt(F.count("value"))
    return table(spark, sf, "events").groupBy("event_type").agg(H.verdict(F.avg("value") - half - 50, F.avg("value") + half - 50).alias("verdict"))


@query("h27_run_tags", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS tag, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events")
def h27(spark, sf):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", H.run_tag(at).alias("tag"), F.unix_seconds(at).alias("seconds"))


_HEADERS = "SELECT s_suppkey, s_name, s_suppkey % 3 AS k FROM supplier"


@query("h28_game_fields", f"""WITH s AS ({_HEADERS}) SELECT s_suppkey, s_name AS white_player, '' AS black_player, CASE WHEN k = 0 THEN 'GM' ELSE '' END AS white_title, '' AS black_title, CASE WHEN k = 1 THEN '600+5' ELSE '' END AS time_control,
'1-0' AS result, '' AS eco, '' AS opening, 'Standard' AS variant, CASE WHEN k = 0 THEN s_suppkey::INT WHEN k = 1 THEN NULL ELSE 0 END AS white_elo, 0 AS black_elo FROM s""")
def h28(spark, sf):
    k = F.col("s_suppkey") % 3
    rating = F.when(k == 0, F.col("s_suppkey").cast("string")).when(k == 1, F.lit("?"))
    tags = F.map_filter(F.create_map(F.lit("White"), F.col("s_name"), F.lit("Result"), F.lit("1-0"), F.lit("WhiteElo"), rating, F.lit("WhiteTitle"), F.when(k == 0, "GM"), F.lit("TimeControl"), F.when(k == 1, "600+5")), lambda _, v: v.isNotNull())
    return table(spark, sf, "supplier").select("s_suppkey", *H.game_fields(tags)).drop("time_category")


@query("h29_router", "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN FALSE ELSE o_totalprice / 100 > 0 AND o_totalprice / 100 - 400 >= 1500 END AS skip FROM orders")
def h29(spark, sf):
    rating = F.when(F.col("o_custkey") % 5 != 0, (F.col("o_totalprice") / 100).cast("string")).otherwise("unrated")
    return table(spark, sf, "orders").select("o_orderkey", H.too_strong(rating, {"<1000": 1000, "1000-1499": 1500, "1500-1999": 2000}, ["<1000", "1000-1499"]).alias("skip"))
