"""Relational completeness over the star schema: joins of all kinds, grouping sets, frames, set operations, JSON and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.dialect import Book, Spark
from cairn.streaming.stateful import follow
from cairn.streaming.windows import settle, windowed
from cairn.tables import load

book = Book()


@book.sql
def rel01_pricing_summary(d: Spark) -> str:
    """Sums and averages by flag and status."""
    return """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n
        FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"""


@book.sql
def rel02_inner_joins(d: Spark) -> str:
    """Revenue by nation through four joins."""
    return """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
        JOIN region ON r_regionkey = n_regionkey GROUP BY n_name"""


@book.sql
def rel03_semi_anti(d: Spark) -> str:
    """Customers with an urgent order, and without any."""
    return """SELECT 'urgent' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')
        UNION ALL SELECT 'none', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"""


@book.sql
def rel04_outer_joins(d: Spark) -> str:
    """Customers and suppliers by nation, either side kept."""
    return """SELECT coalesce(c.k, s.k) AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) c
        FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c.k = s.k"""


@book.sql
def rel05_theta_range_join(d: Spark) -> str:
    """Orders by the band of their price."""
    bands = d.rows([(0, 50000, "low"), (50000, 150000, "mid"), (150000, 100000000, "high")], "lo, hi, band")
    return f"SELECT band, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders JOIN {bands} b ON o_totalprice >= lo AND o_totalprice < hi GROUP BY band"


@book.sql
def rel06_asof_join(d: Spark) -> str:
    """Each purchase with the last view of the same user before it."""
    return """SELECT event_id, last_view FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events) t WHERE event_type = 'purchase'"""


@book.sql
def rel07_cube(d: Spark) -> str:
    """Orders by status and priority with all totals."""
    return "SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"


@book.sql
def rel08_grouping_sets(d: Spark) -> str:
    """Parts by brand and by size class."""
    return "SELECT p_brand, CASE WHEN p_size IS NULL THEN NULL ELSE p_size END AS size, count(*) AS n, round(max(p_retailprice), 2) AS dearest FROM part GROUP BY GROUPING SETS ((p_brand), (p_size))"


@book.sql
def rel09_row_frames(d: Spark) -> str:
    """Moving mean of three values by user."""
    return "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3 FROM events"


@book.sql
def rel10_range_frames(d: Spark) -> str:
    """Orders of a customer priced within 1,000 of each order."""
    return "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS n FROM orders"


@book.sql
def rel11_ranking(d: Spark) -> str:
    """Ranks of customers by balance within their segment."""
    return """SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS quarter, round(percent_rank() OVER w, 6) AS pr FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)"""


@book.sql
def rel12_lag_lead(d: Spark) -> str:
    """Days between orders of a customer."""
    return f"SELECT o_orderkey, ({d.epoch('o_orderdate')} - lag({d.epoch('o_orderdate')}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) / 86400000000 AS gap FROM orders"


@book.sql
def rel13_set_operations(d: Spark) -> str:
    """Nations of customers, suppliers, both, and only one."""
    return """SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) a
        UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) b
        UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) c"""


@book.sql
def rel14_top_k(d: Spark) -> str:
    """The three dearest parts of each brand."""
    return "SELECT p_brand, p_partkey, k FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) t WHERE k <= 3"


@book.sql
def rel15_json(d: Spark) -> str:
    """Sums of a number inside JSON."""
    return f"SELECT event_type, {d.big(f'sum({d.try_int(d.json("props", "k"))})')} AS total FROM events GROUP BY event_type"


@book.sql
def rel16_arrays(d: Spark) -> str:
    """Event types of each user as a sorted set, and how many events there are."""
    return f"SELECT user_id, {d.gather_set('event_type')} AS kinds, count(*) AS n FROM events GROUP BY user_id"


@book.sql
def rel17_pivot(d: Spark) -> str:
    """Orders by status in columns."""
    return "SELECT o_orderpriority, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority"


@book.sql
def rel18_subqueries(d: Spark) -> str:
    """Parts dearer than the mean of their brand."""
    return "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)"


@book.sql
def rel19_distinct_aggregates(d: Spark) -> str:
    """Distinct users and days by event type."""
    return f"SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT {d.day('ts')}) AS days, count(*) AS n FROM events GROUP BY event_type"


@book.sql
def rel20_sessions(d: Spark) -> str:
    """Sessions of users parted by six hours of silence."""
    gap = f"{d.epoch('ts')} - lag({d.epoch('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    return f"""SELECT user_id, session, count(*) AS n FROM (SELECT user_id, {d.big('sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS session
        FROM (SELECT user_id, ts, event_id, CASE WHEN coalesce({gap}, 21600000001) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM events) a) b GROUP BY user_id, session"""


@book.sql
def rel21_quantiles(d: Spark) -> str:
    """Exact median and quartiles by event type."""
    q = (lambda p: f"percentile(value, {p})") if d.name == "spark" else (lambda p: f"quantile_cont(value, {p})")
    return f"SELECT event_type, round({q(0.5)}, 6) AS median, round({q(0.25)}, 6) AS q1, round({q(0.75)}, 6) AS q3 FROM events GROUP BY event_type"


@book.sql
def rel22_vectors(d: Spark) -> str:
    """Size and length of each vector, by its components."""
    return f"SELECT vec_id, {d.size('embedding')} AS dims, round(sqrt({d.sum(d.map('embedding', 'x', 'cast(x AS DOUBLE) * cast(x AS DOUBLE)'))}), 4) AS norm FROM embeddings"


@book.sql
def rel23_daily_windows(d: Spark) -> str:
    """Events and value by day and type."""
    return f"SELECT {d.day('ts')} AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY {d.day('ts')}, event_type"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return follow(spark, f"{d}/events.parquet", load(spark, d, "events").schema).select("event_type", "user_id", F.col("ts").cast("timestamp").alias("at"), "value")



@book.frame("SELECT epoch_us(time_bucket(INTERVAL '1' DAY, ts)) AS started, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def rel24_streamed_days(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of a day over the event stream."""
    w = windowed(_stream(spark, d), "at", ["event_type"], {"n": F.count("*"), "value": F.sum("value")}, "1 day")
    return settle(spark, w, ["event_type"]).select(F.unix_micros("start").alias("started"), "event_type", "n", F.round("value", 4).alias("value"))


@book.frame("SELECT epoch_us(s) AS started, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '12' HOUR, ts), time_bucket(INTERVAL '12' HOUR, ts) - INTERVAL '12' HOUR]) AS s FROM events WHERE ts IS NOT NULL) t GROUP BY ALL")
def rel25_streamed_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows of a day every twelve hours over the event stream."""
    w = windowed(_stream(spark, d), "at", ["event_type"], {"n": F.count("*")}, "24 hours", "12 hours")
    return settle(spark, w, ["event_type"]).select(F.unix_micros("start").alias("started"), "event_type", "n")


@book.frame("""SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6' HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL) a) b GROUP BY user_id, s""")
def rel26_streamed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session windows of users, parted by six hours of silence, over the event stream."""
    w = windowed(_stream(spark, d).where("user_id is not null"), "at", ["user_id"], {"n": F.count("*")}, "6 hours", gap=True, late="400 days")
    return settle(spark, w, ["user_id"], "complete").select("user_id", F.unix_micros("start").alias("started"), "n")


@book.frame()
def rel27_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users and median by event type, by sketches with stated errors of 2 % and a thousandth of the rows."""
    return load(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5, 1000).alias("median"))
