"""Queries of services, evaluators and stateful streams.  The clients are deterministic doubles; what is shown is how a client is asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import scalars as S
from tidelake.operators import windows as O
from tidelake.plans.board_queries import FENS
from tidelake.plans.catalog import query
from tidelake.plans.source_queries import _new
from tidelake.plans.tables import r6, table
from tidelake.sources import services as V
from tidelake.sources import writers as W
from tidelake.streaming import operators as K


def _rosters():
    return lambda title: {"players": [f"{title.lower()}{k}" for k in range(2 * len(title))]}


@query("a12_rosters", "WITH t AS (SELECT unnest(['GM', 'IM', 'FM', 'WGM']) AS title) SELECT title, lower(title) || k AS username FROM t, range(6) AS r(k) WHERE k < 2 * length(title)")
def a12(spark, sf):
    titles = spark.createDataFrame([("GM",), ("IM",), ("FM",), ("WGM",)], "title string")
    return V.ask(titles, "title", _rosters, "players array<string>", {"players": []}).select("title", F.explode("players").alias("username"))


def _profiles():
    """Of every seven keys one is always refused, one twice, and one fails once."""
    seen = {}

    def answer(k: int) -> dict:
        seen[k] = seen.get(k, 0) + 1
        if k % 7 == 0 or (k % 7 == 1 and seen[k] < 3):
            raise V.Refused
        if k % 7 == 2 and seen[k] < 2:
            raise OSError
        return {"name": f"player {k}", "country": f"https://x/country/{'de' if k % 2 else 'fr'}"}

    return answer


@query("a13_k7_profiles", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'player ' || c_custkey END AS name, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 2 = 1 THEN 'DE' ELSE 'FR' END AS country, CASE c_custkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS tried FROM customer")
def a13(spark, sf):
    found = V.ask(table(spark, sf, "customer"), "c_custkey", _profiles, "name string, country string", {"name": "", "country": ""}, refused=0.0, failed=0.0)
    return found.select("c_custkey", "name", F.upper(S.last_segment(F.col("country"))).alias("country"), "tried")


@query("a15_exact_search", "WITH h AS (SELECT q.q, p.p_partkey FROM part p JOIN (SELECT 1 AS q, 'red' AS a, 'widget' AS b UNION ALL SELECT 2, 'blue', 'bolt') q ON list_contains(string_split(p_name, ' '), q.a) AND list_contains(string_split(p_name, ' '), q.b)) SELECT q, p_partkey FROM h QUALIFY row_number() OVER (PARTITION BY q ORDER BY p_partkey) <= 5")
def a15(spark, sf):
    asked = spark.createDataFrame([(1, ["red", "widget"]), (2, ["blue", "bolt"])], "q int, asked_tokens array<string>")
    return V.exact_search(table(spark, sf, "part"), "p_partkey", F.split("p_name", " "), asked, "q", "asked_tokens", 5)


@query("a17_targeted_fetch", """WITH a AS (SELECT o_custkey, o_orderkey, o_orderkey // 1000 + o_custkey % 3 AS mon FROM orders), u AS (SELECT DISTINCT o_custkey, mon FROM a),
t AS (SELECT a.o_custkey, o_orderkey, u.mon, a.mon AS own, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(u.mon - o_orderkey // 1000), u.mon) AS n FROM a JOIN u ON u.o_custkey = a.o_custkey)
SELECT o_custkey, o_orderkey, min(mon) FILTER (WHERE mon = own AND n <= 2) AS mon, min(n) FILTER (WHERE mon = own AND n <= 2)::INT AS tries FROM t GROUP BY 1, 2""")
def a17(spark, sf):
    o = table(spark, sf, "orders")
    thousand = F.floor(F.col("o_orderkey") / 1000)
    archive = o.select("o_custkey", "o_orderkey", (thousand + F.col("o_custkey") % 3).alias("mon"))
    known = o.filter("o_orderkey % 1000 in (0, 999)").select("o_orderkey", thousand.alias("mon"))
    return V.targeted_fetch(o, known, archive, "o_custkey", "mon", "o_orderkey", most=2)


@query("a18_root_search")
def a18(spark, sf):
    return V.searched(spark.createDataFrame(list(enumerate(FENS)), "id int, fen string"), "fen", V.material_engine).select("id", F.posexplode("lines").alias("k", "x")).select("id", "k", "x.*")


@query("a19_history_search")
def a19(spark, sf):
    games = [(1, ["e4", "e5"], "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"), (2, ["e4", "d5", "exd5"], "rnbqkbnr/ppp1pppp/8/3P4/8/8/PPPP1PPP/RNBQKBNR b KQkq - 0 2")]
    at = spark.createDataFrame(games, "id int, played array<string>, fen string")
    return V.searched(at, "fen", V.material_engine, 1, "played").select("id", F.col("lines")[0]["move"].alias("move"), F.col("lines")[0]["cp"].alias("cp"))


_CP = "CASE WHEN l_quantity = 50 THEN 10000 WHEN l_quantity = 49 THEN -10000 ELSE l_quantity * 20 - 500 END"
_OWN = f"50 + 50 * (2 / (1 + exp(-0.00368208 * ({_CP}))) - 1)"
#: An order's lines are an evaluator's; one of 17 orders ends in mate, one in a draw, one has no line.
_LINES = f"""WITH l AS (SELECT l_orderkey AS id, list({{'m': l_partkey::VARCHAR, 'w': {_OWN}}} ORDER BY l_linenumber, l_partkey, l_quantity) AS x FROM lineitem GROUP BY 1),
s AS (SELECT id, CASE id % 17 WHEN 0 THEN 'checkmate' WHEN 1 THEN 'draw' ELSE '' END AS t, CASE WHEN id % 17 <= 2 THEN [] ELSE x[:5] END AS x FROM l), o AS (SELECT *, list_transform(x, lambda e: 100 - e.w) AS w FROM s) """


def _lines(spark, sf):
    q = F.col("l_quantity")
    line = F.struct(F.col("l_partkey").cast("string").alias("move"), (q * 20 - 500).cast("int").alias("cp"), F.when(q == 50, 3).when(q == 49, -2).alias("mate"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", line.alias("x")))).alias("x"))
    end = F.col("id") % 17
    lines = F.when(end <= 2, F.slice(F.col("x.x"), 1, 0)).otherwise(F.slice(F.col("x.x"), 1, 5))
    return rows.select("id", lines.alias("lines"), F.when(end == 0, "checkmate").when(end == 1, "draw").otherwise("").alias("ends"))


@query("a20_child_value", _LINES + "SELECT id, round(CASE t WHEN 'checkmate' THEN 50 + 50 * (2 / (1 + exp(-36.8208)) - 1) WHEN 'draw' THEN 50 ELSE w[1] END, 6) AS wp FROM o")
def a20(spark, sf):
    return _lines(spark, sf).select("id", r6(V.child_value(F.col("lines"), F.col("ends"))).alias("wp"))


@query("a21_successor_summary", _LINES + """SELECT id, round(CASE t WHEN 'checkmate' THEN 100 WHEN 'draw' THEN 50 ELSE w[1] END, 6) AS lo, round(CASE t WHEN 'checkmate' THEN 100 WHEN 'draw' THEN 50 ELSE w[-1] END, 6) AS hi,
round(CASE WHEN t <> '' THEN 0 ELSE w[-1] - w[1] END, 6) AS steep, round(CASE WHEN t <> '' THEN 0 ELSE list_aggregate(w, 'stddev_pop') END, 4) AS spread, len(w)::INT AS n_pv, CASE WHEN t = '' AND len(w) = 0 THEN 'no_pv' ELSE t END AS terminal FROM o""")
def a21(spark, sf):
    out = _lines(spark, sf).select("id", *V.successor_summary(F.col("lines"), F.col("ends")))
    return out.select("id", *[r6(F.col(c)).alias(c) for c in ("lo", "hi", "steep")], F.round("spread", 4).alias("spread"), "n_pv", "terminal")


@query("a22_successor_lines", _LINES + "SELECT id, " + ", ".join(f"x[{k}].m AS mv_{k}, round(w[{k}], 6) AS wp_self_{k}" for k in range(1, 6)) + " FROM o")
def a22(spark, sf):
    out = _lines(spark, sf).select("id", *V.successor_lines(F.col("lines"), F.col("ends")))
    return out.select("id", *[c if c.startswith("mv_") else r6(F.col(c)).alias(c) for c in out.columns[1:]])


@query("a23_reply_value", _LINES + "SELECT id, round(CASE t WHEN 'checkmate' THEN 50 + 50 * (2 / (1 + exp(36.8208)) - 1) WHEN 'draw' THEN 50 ELSE x[1].w END, 6) AS wp FROM o")
def a23(spark, sf):
    return _lines(spark, sf).select("id", r6(V.reply_value(F.col("lines"), F.col("ends"))).alias("wp"))


@query("a27_b9_draws", "SELECT o_orderkey % 3 AS draw, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def a27(spark, sf):
    path, o = _new(spark, "draws"), table(spark, sf, "orders")
    for d in (0, 1, 2, 1):  # the fourth is there already and is left alone
        W.write_draw(o.filter(F.col("o_orderkey") % 3 == d).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), path, d)
    return spark.read.parquet(path).select(F.col("draw").cast("long").alias("draw"), "o_orderstatus", "n")


def _stream(spark, sf):
    """The events as a stream of files, whether the table is a folder of files or one file (streams want a folder)."""
    path = f"{sf}/events.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    rows = spark.readStream.schema(spark.read.parquet(path).schema)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return rows.parquet(path)
    return rows.option("pathGlobFilter", "events.parquet").parquet(sf)


@query("k2_append_new", "SELECT DISTINCT 'u' || user_id AS name FROM events")
def k2(spark, sf):
    path = _new(spark, "names")
    written = F.concat(F.when(F.col("event_id") % 2 == 0, "U").otherwise("u"), F.col("user_id").cast("string"))
    K.run_available(_stream(spark, sf).select(F.lower(written).alias("name")), _new(spark, "checkpoint"), K.append_new(path, ["name"]))
    return W.stored(spark, path, ["name"])


@query("k3_flushed", "SELECT event_id, event_type FROM events")
def k3(spark, sf):
    """Files in, one a flush; stopped after some and taken up again."""
    source, path, checkpoint = _new(spark, "in"), _new(spark, "out"), _new(spark, "checkpoint")
    rows = table(spark, sf, "events").select("event_id", "event_type")
    for part in (0, 1):
        rows.filter(F.col("event_id") % 2 == part).repartition(2).write.mode("append").parquet(source)
        K.run_available(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), checkpoint, K.append_new(path, ["event_id"]))
    return W.stored(spark, path, ["event_id"])


@query("k4_quota_stream", "SELECT event_type, least(count(*), CASE event_type WHEN 'click' THEN 50 WHEN 'view' THEN 1000000 WHEN 'error' THEN 7 ELSE 0 END) AS n FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1")
def k4(spark, sf):
    path = _new(spark, "quota")
    taken = K.with_quota(_stream(spark, sf).select("event_type", "event_id"), "event_type", {"click": 50, "view": 1_000_000, "error": 7})
    K.run_available(taken, _new(spark, "checkpoint"), K.last_states(path))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("k5_curve_stream", "SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1")
def k5_stream(spark, sf):
    path = _new(spark, "curve")
    K.run_available(K.min_max_curve(_stream(spark, sf), "user_id", "event_id"), _new(spark, "checkpoint"), K.last_states(path), "update")
    return K.read_last(spark, path, "user_id")


@query("k6_resetting_stream", """WITH RECURSIVE h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type = 'purchase'),
w(user_id, i, held, n) AS (SELECT user_id, 1::BIGINT, event_id, 0 FROM h WHERE i = 1
UNION ALL SELECT h.user_id, h.i, CASE WHEN w.held IS NOT NULL AND h.event_id - w.held <= 400 THEN NULL ELSE h.event_id END, w.n + CASE WHEN w.held IS NOT NULL AND h.event_id - w.held <= 400 THEN 1 ELSE 0 END FROM w JOIN h ON h.user_id = w.user_id AND h.i = w.i + 1)
SELECT user_id, events FROM (SELECT user_id, max(n)::INT AS events FROM w GROUP BY 1 UNION ALL SELECT user_id, 0 FROM (SELECT DISTINCT user_id FROM events EXCEPT SELECT user_id FROM h))""")
def k6(spark, sf):
    path = _new(spark, "storms")
    start, step, state = K.resetting(lambda r: r["event_type"] == "purchase", "event_id", 400)
    K.run_available(K.folded_by_key(_stream(spark, sf).select("user_id", "event_id", "event_type"), "user_id", "event_id", start, step, state), _new(spark, "checkpoint"), K.last_states(path), "update")
    return K.read_last(spark, path, "user_id").select("user_id", "events")


@query("k6_runs_stream", "WITH f AS (SELECT user_id, event_id, event_type = 'click' AS f, lag(event_type = 'click', 1, false) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, count(*) FILTER (WHERE f AND NOT p)::INT AS runs, count(*) FILTER (WHERE f)::INT AS total FROM f GROUP BY 1")
def k6_runs(spark, sf):
    path = _new(spark, "runs")
    start, step, state = K.run_state(lambda r: r["event_type"] == "click")
    K.run_available(K.folded_by_key(_stream(spark, sf).select("user_id", "event_id", "event_type"), "user_id", "event_id", start, step, state), _new(spark, "checkpoint"), K.last_states(path), "update")
    return K.read_last(spark, path, "user_id").select("user_id", "runs", "total")


@query("e31_quota_until_stalled", """WITH t AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE NOT (event_type = 'view' AND value > 20)),
k AS (SELECT * FROM t WHERE r <= CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 60 WHEN 'error' THEN 30 ELSE 0 END),
g AS (SELECT *, coalesce(event_id - lag(event_id) OVER (ORDER BY event_id) > 25, false) AS gap FROM k)
SELECT event_id, event_type FROM (SELECT *, bool_or(gap) OVER (ORDER BY event_id) AS off FROM g) WHERE NOT off""")
def e31_stalled(spark, sf):
    routed = table(spark, sf, "events").filter(~((F.col("event_type") == "view") & (F.col("value") > 20))).select("event_id", "event_type")
    return O.until_stalled(O.quota(routed, "event_type", {"click": 5, "view": 60, "error": 30}, ["event_id"]), "event_id", 25)
