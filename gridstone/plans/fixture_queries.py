"""The engine's operators on the star-schema tables, each with the SQL it must equal.

Orders stand for games (two customers' classes as teams, points from the price),
events for the rows of a team or player, lines for stamped reports.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridstone.functions.expressions import implied_probability, no_vig, ratio, truth
from gridstone.operators import metrics, records, scans
from gridstone.operators import timeseries as ts
from gridstone.operators.asof import strict_asof
from gridstone.operators.ratings import elo

TEAMS = 32
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


# ---------------------------------------------------------------- shared inputs

GAMES = f"""
games AS (
    SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS season, o_custkey % {TEAMS} AS home,
           (o_custkey % {TEAMS} + 1 + o_orderkey % {TEAMS - 1}) % {TEAMS} AS away,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) % 45 END AS home_score,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) // 45 % 42 END AS away_score
    FROM orders
)"""
LONG = (
    GAMES
    + """,
long AS (
    SELECT *, CAST(pf IS NOT NULL AS BIGINT) AS played, CAST(coalesce(pf > pa, false) AS BIGINT) AS win,
           CAST(coalesce(pf < pa, false) AS BIGINT) AS loss, CAST(coalesce(pf = pa, false) AS BIGINT) AS tie, coalesce(pf - pa, 0) AS diff
    FROM (SELECT game_id, day, season, home AS team, away AS opp, home_score AS pf, away_score AS pa, 1 AS is_home FROM games
          UNION ALL SELECT game_id, day, season, away, home, away_score, home_score, 0 FROM games)
)"""
)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    played = F.col("o_orderstatus") != "P"
    home = F.col("o_custkey") % TEAMS
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"),
        F.to_date("o_orderdate").alias("day"),
        F.year("o_orderdate").cast("long").alias("season"),
        home.alias("home"),
        ((home + 1 + F.col("o_orderkey") % (TEAMS - 1)) % TEAMS).alias("away"),
        F.when(played, cents % 45).alias("home_score"),
        F.when(played, F.floor(cents / 45) % 42).alias("away_score"),
    )


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = {"team": ("home", "away"), "opp": ("away", "home"), "pf": ("home_score", "away_score"), "pa": ("away_score", "home_score")}
    rows = records.two_sided(games(spark, sf_dir), sides, ["game_id", "day", "season"])
    flag = lambda c: truth(c).cast("long")
    pf, pa = F.col("pf"), F.col("pa")
    return rows.withColumns(
        {"played": pf.isNotNull().cast("long"), "win": flag(pf > pa), "loss": flag(pf < pa), "tie": flag(pf == pa), "diff": F.coalesce(pf - pa, F.lit(0))}
    )


ORDER = ["day", "game_id"]

# ---------------------------------------------------------------- windows


@query(
    f"""
    WITH {LONG}, f AS (
        SELECT game_id, is_home, coalesce(sum(played) OVER w, 0) AS games_played, coalesce(sum(win) OVER w, 0) AS wins,
               coalesce(sum(win + 0.5 * tie) OVER w, 0) AS points, coalesce(sum(diff) OVER w, 0) AS diffs
        FROM long WINDOW w AS (PARTITION BY team, season ORDER BY day, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), g AS (
        SELECT *, CASE WHEN games_played > 0 THEN CAST(points AS DOUBLE) / CAST(games_played AS DOUBLE) END AS win_pct,
               CASE WHEN games_played > 0 THEN CAST(diffs AS DOUBLE) / CAST(games_played AS DOUBLE) END AS avg_diff
        FROM f
    )
    SELECT h.game_id, CAST(h.wins AS BIGINT) AS home_wins, CAST(a.wins AS BIGINT) AS away_wins, CAST(h.wins - a.wins AS BIGINT) AS diff_wins,
           round(h.win_pct, 6) AS home_win_pct, round(a.win_pct, 6) AS away_win_pct, round(h.win_pct - a.win_pct, 6) AS diff_win_pct,
           round(h.avg_diff, 6) AS home_avg_diff, round(a.avg_diff, 6) AS away_avg_diff, round(h.avg_diff - a.avg_diff, 6) AS diff_avg_diff
    FROM g h JOIN g a ON h.game_id = a.game_id AND h.is_home = 1 AND a.is_home = 0
    """
)
def pregame_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.wide(record_rows(spark, sf_dir), "game_id", RECORD)
    return out.select("game_id", *recorded(out.columns[1:]))


RECORD = ["wins", "win_pct", "avg_diff"]


def recorded(columns: Sequence[str]) -> list[Column]:
    return [F.col(c) if c.endswith("wins") else rnd(F.col(c)).alias(c) for c in columns]


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a team and game with the team's record before it."""
    by = ["team", "season"]
    rows = long(spark, sf_dir).withColumns(
        {
            "games_played": ts.prior_sum("played", by, ORDER),
            "wins": ts.prior_sum("win", by, ORDER),
            "points": ts.prior_sum(F.col("win") + 0.5 * F.col("tie"), by, ORDER),
            "diffs": ts.prior_sum("diff", by, ORDER),
        }
    )
    return rows.withColumn("win_pct", ratio("points", "games_played")).withColumn("avg_diff", ratio("diffs", "games_played"))


@query(
    f"""
    WITH {LONG}
    SELECT game_id, team, CAST(sum(diff) OVER w AS BIGINT) AS last3_diff, CAST(sum(played) OVER w AS BIGINT) AS last3_played,
           round(CASE WHEN sum(played) OVER w > 0 THEN CAST(sum(win) OVER w AS DOUBLE) / CAST(sum(played) OVER w AS DOUBLE) END, 6) AS last3_win_pct
    FROM long WINDOW w AS (PARTITION BY team, season ORDER BY day, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
    """
)
def last3_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["team", "season"]
    rows = long(spark, sf_dir).withColumns({c: ts.rolling_prior(v, by, ORDER, 3) for c, v in (("last3_diff", "diff"), ("last3_played", "played"), ("_w", "win"))})
    return rows.select("game_id", "team", "last3_diff", "last3_played", rnd(ratio("_w", "last3_played")).alias("last3_win_pct"))


EVENTS = """
e AS (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'click' THEN value END AS v, event_type FROM events)"""


@query(
    f"""
    WITH {EVENTS}, p AS (SELECT *, pow(2.0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 4096 / 8.0) AS w FROM e)
    SELECT event_id, round(CASE WHEN sum(w) FILTER (v IS NOT NULL) OVER x > 0 THEN sum(v * w) OVER x / sum(w) FILTER (v IS NOT NULL) OVER x END, 6) AS ewm
    FROM p WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """
)
def ewm_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") != "click", F.col("value")))
    return ts.ewm_prior(rows, "v", ["user_id"], ["ts", "event_id"], 8.0, "ewm").select("event_id", rnd(F.col("ewm")).alias("ewm"))


@query(
    f"""
    WITH {LONG}, o AS (SELECT *, CASE WHEN played = 1 THEN win - loss END AS outcome FROM long),
    c AS (SELECT *, coalesce(outcome <> lag(outcome) OVER (PARTITION BY team ORDER BY day, game_id), true) AS changed FROM o WHERE outcome IS NOT NULL),
    r AS (SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY team ORDER BY day, game_id) AS run FROM c),
    s AS (SELECT game_id, team, outcome * row_number() OVER (PARTITION BY team, run ORDER BY day, game_id) AS signed FROM r)
    SELECT o.game_id, o.team, CAST(coalesce(last_value(signed IGNORE NULLS) OVER (PARTITION BY o.team ORDER BY day, o.game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS streak
    FROM o LEFT JOIN s ON o.game_id = s.game_id AND o.team = s.team
    """
)
def streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long(spark, sf_dir).withColumn("outcome", F.when(F.col("played") == 1, F.col("win") - F.col("loss")))
    return ts.streak(rows, "outcome", ["team"], ORDER, "streak").select("game_id", "team", "streak")


@query(
    f"""
    WITH {LONG}
    SELECT game_id, team, CAST(last_value(CASE WHEN played = 1 THEN diff END IGNORE NULLS) OVER w AS BIGINT) AS last_margin,
           CAST(last_value(CASE WHEN played = 1 THEN win END IGNORE NULLS) OVER w AS BIGINT) AS last_won,
           CAST(date_diff('day', last_value(CASE WHEN played = 1 THEN day END IGNORE NULLS) OVER w, day) AS BIGINT) AS days_since,
           CAST(coalesce(sum(played) OVER w, 0) AS BIGINT) AS meetings
    FROM long WINDOW w AS (PARTITION BY team, opp ORDER BY day, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """
)
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["team", "opp"]
    known = lambda c: ts.last_known(F.when(F.col("played") == 1, F.col(c)), by, ORDER)
    rows = long(spark, sf_dir).withColumns({"last_margin": known("diff"), "last_won": known("win"), "_d": known("day"), "meetings": ts.prior_sum("played", by, ORDER)})
    return rows.select("game_id", "team", "last_margin", "last_won", F.datediff("day", "_d").cast("long").alias("days_since"), "meetings")


@query(
    """
    WITH n AS (SELECT event_id, user_id, ts, event_type, week(ts) AS season,
                      coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS changed FROM events),
    s AS (SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stint FROM n)
    SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, stint ORDER BY ts, event_id) - 1 AS BIGINT) AS tenure,
           CASE WHEN season > min(season) OVER () THEN CAST(min(season) OVER (PARTITION BY user_id, stint) = season AS BIGINT) END AS new_this_season
    FROM s
    """
)
def coach_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("season", F.weekofyear("ts"))
    first = events.agg(F.min("season").alias("first_season"))  # one row
    rows = ts.islands(events, "event_type", ["user_id"], ["ts", "event_id"], "stint").crossJoin(F.broadcast(first))
    began = F.min("season").over(Window.partitionBy("user_id", "stint")) == F.col("season")
    return rows.select(
        "event_id", ts.count_before(["user_id", "stint"], ["ts", "event_id"]).alias("tenure"), F.when(F.col("season") > F.col("first_season"), began.cast("long")).alias("new_this_season")
    )


@query(
    f"""
    WITH {LONG}
    SELECT game_id, team, CAST(count(*) OVER w AS BIGINT) AS n_history,
           coalesce(string_agg(CAST(diff AS VARCHAR), ',' ORDER BY day, game_id) OVER w, '') AS history
    FROM long WINDOW w AS (PARTITION BY team ORDER BY day, game_id ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)
    """.replace(" ORDER BY day, game_id) OVER w, '')", ") OVER w, '')")
)
def game_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, mask = ts.padded_history(F.col("diff"), ["team"], ORDER, 16)
    rows = long(spark, sf_dir).select("game_id", "team", values.alias("h"), mask.alias("m"))
    return rows.select("game_id", "team", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_history"), F.array_join(F.transform(F.filter("h", lambda x: x.isNotNull()), lambda x: x.cast("string")), ",").alias("history"))


# ---------------------------------------------------------------- joins


@query(
    """
    WITH b AS (SELECT l_orderkey AS game_id, l_linenumber % 2 AS side, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS BIGINT) AS yards FROM lineitem GROUP BY 1, 2)
    SELECT o.o_orderkey AS game_id, CAST(s.side AS BIGINT) AS side, own.qty AS o_qty, own.yards AS o_yards, opp.qty AS d_qty, opp.yards AS d_yards,
           CASE WHEN own.qty > 0 THEN own.yards // own.qty END AS o_per_qty
    FROM orders o CROSS JOIN (VALUES (0), (1)) s(side)
    LEFT JOIN b own ON own.game_id = o.o_orderkey AND own.side = s.side
    LEFT JOIN b opp ON opp.game_id = o.o_orderkey AND opp.side = 1 - s.side
    """
)
def box_rollup_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    box = lines.groupBy(F.col("l_orderkey").alias("game_id"), (F.col("l_linenumber") % 2).cast("long").alias("side")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("long")).alias("yards")
    )
    # both sides of a game in one row: own and opponent's figures need no second join
    sides = box.groupBy("game_id").agg(*(F.max(F.when(F.col("side") == k, F.struct("qty", "yards"))).alias(f"s{k}") for k in (0, 1)))
    whole = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id")).join(sides, "game_id", "left")
    entry = lambda k: F.struct(F.lit(k).cast("long").alias("side"), F.col(f"s{k}").alias("own"), F.col(f"s{1 - k}").alias("opp"))
    rows = whole.select("game_id", F.explode(F.array(entry(0), entry(1))).alias("e")).select("game_id", "e.*")
    figures = [F.col(c).alias(n) for c, n in (("own.qty", "o_qty"), ("own.yards", "o_yards"), ("opp.qty", "d_qty"), ("opp.yards", "d_yards"))]
    return rows.select("game_id", "side", *figures, F.when(F.col("own.qty") > 0, F.expr("own.yards div own.qty")).alias("o_per_qty"))


@query(
    """
    WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
    p AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, round(v.value, 6) AS last_view FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.day > v.day
    """
)
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    views = events.filter("event_type = 'view'").select("user_id", "day", "event_id", "value")
    buys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "day")
    return strict_asof(buys, views, ["user_id"], "day", "day", ["value"], ties=["event_id"]).select("event_id", rnd(F.col("value")).alias("last_view"))


@query(
    """
    WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS key FROM orders GROUP BY 1, 2)
    SELECT o.o_orderkey, r.key AS prior_order, round(r.price, 2) AS prior_price
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders) o ASOF LEFT JOIN r ON o.o_custkey = r.o_custkey AND o.day > r.day
    """
)
def asof_date_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    right = orders.withColumn("prior_order", F.col("o_orderkey"))
    right = right.select("o_custkey", "day", "prior_order", F.col("o_totalprice").alias("prior_price"))
    return strict_asof(orders, right, ["o_custkey"], "day", "day", ["prior_order", "prior_price"], ties=["prior_order"]).select("o_orderkey", "prior_order", F.round("prior_price", 2).alias("prior_price"))


@query(
    """
    WITH v AS (SELECT user_id % 2 AS half, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
    p AS (SELECT event_id, user_id % 2 AS half, ts FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, round(v.value, 6) AS last_view FROM p ASOF LEFT JOIN v ON p.half = v.half AND p.ts > v.ts
    """
)
def asof_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of join by two keys that hold all rows, each over many tasks."""
    events = load(spark, sf_dir, "events").withColumn("half", F.col("user_id") % 2)
    views = events.filter("event_type = 'view'").select("half", "ts", "value")
    buys = events.filter("event_type = 'purchase'").select("event_id", "half", "ts")
    return scans.strict_asof(buys, views, ["half"], "ts", "ts", ["value"], ties=["value"]).select("event_id", rnd(F.col("value")).alias("last_view"))


@query(
    """
    SELECT o_orderkey, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w, 0) AS BIGINT) AS spent, CAST(count(*) OVER w AS BIGINT) AS orders,
           last_value(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END IGNORE NULLS) OVER w AS last_open
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """
)
def prefix_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, counts and latest known values before each row by a few keys that hold all rows, each over many tasks."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).alias("open"))
    got = scans.prefixes(orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], sums={"spent": "cents"}, lasts={"last_open": "open"}, counts=["orders"])
    return got.select("o_orderkey", "spent", "orders", "last_open")


@query(
    """
    WITH q AS (
        SELECT user_id, CAST(ts AS DATE) AS day, event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER c AS c_num, count(*) OVER c AS c_games,
               sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS r_num,
               sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, week(ts) ORDER BY ts, event_id) AS s_num, week(ts) AS s
        FROM events WHERE event_type = 'purchase' WINDOW c AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), d AS (SELECT user_id, day, arg_max(c_num, event_id) AS c_num, arg_max(c_games, event_id) AS c_games, arg_max(r_num, event_id) AS r_num, arg_max(s_num, event_id) AS s_num, arg_max(s, event_id) AS s FROM q GROUP BY 1, 2),
    l AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, week(ts) AS w FROM events WHERE event_type = 'signup')
    SELECT l.event_id, CAST(coalesce(d.c_games, 0) AS BIGINT) AS career_games, CAST(d.c_num // d.c_games AS BIGINT) AS career_avg, CAST(d.r_num AS BIGINT) AS last8, CAST(CASE WHEN d.s = l.w THEN d.s_num END AS BIGINT) AS season_num
    FROM l ASOF LEFT JOIN d ON l.user_id = d.user_id AND l.day > d.day
    """
)
def qb_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["ts", "event_id"]
    events = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("w", F.weekofyear("ts")).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    rows = events.filter("event_type = 'purchase'").withColumns(
        {
            "c_num": ts.running_sum("value", ["user_id"], order),
            "c_games": ts.count_before(["user_id"], order) + 1,
            "r_num": ts.running_sum("value", ["user_id"], order, 8),
            "s_num": ts.running_sum("value", ["user_id", "w"], order),
            "s": F.col("w"),
        }
    )
    left = events.filter("event_type = 'signup'").select("event_id", "user_id", "day", "w")
    got = strict_asof(left, rows.select("user_id", "day", "event_id", "c_num", "c_games", "r_num", "s_num", "s"), ["user_id"], "day", "day", ["c_num", "c_games", "r_num", "s_num", "s"], ties=["event_id"])
    return got.select(
        "event_id",
        F.coalesce("c_games", F.lit(0)).cast("long").alias("career_games"),
        F.when(F.col("c_games") > 0, F.expr("c_num div c_games")).alias("career_avg"),
        F.col("r_num").alias("last8"),
        F.when(F.col("s") == F.col("w"), F.col("s_num")).alias("season_num"),
    )


@query(
    f"""
    WITH {LONG}, t AS (SELECT team, season, sum(win) + 0.5 * sum(tie) AS points, sum(played) AS n, sum(diff) AS diff FROM long GROUP BY 1, 2)
    SELECT l.game_id, l.team, round(CASE WHEN t.n > 0 THEN CAST(t.points AS DOUBLE) / CAST(t.n AS DOUBLE) END, 6) AS prev_win_pct, round(CASE WHEN t.n > 0 THEN CAST(t.diff AS DOUBLE) / CAST(t.n AS DOUBLE) END, 6) AS prev_diff
    FROM long l LEFT JOIN t ON l.team = t.team AND l.season = t.season + 1
    """
)
def prior_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long(spark, sf_dir)
    totals = rows.groupBy("team", (F.col("season") + 1).alias("season")).agg((F.sum("win") + 0.5 * F.sum("tie")).alias("p"), F.sum("played").alias("n"), F.sum("diff").alias("d"))
    return rows.join(totals, ["team", "season"], "left").select("game_id", "team", rnd(ratio("p", "n")).alias("prev_win_pct"), rnd(ratio("d", "n")).alias("prev_diff"))


@query(
    """
    WITH c AS (SELECT user_id, week(ts) AS season, event_type, count(*) AS n, min((ts, event_id)) AS first FROM events GROUP BY 1, 2, 3)
    SELECT user_id, CAST(season AS BIGINT) AS season, event_type AS main FROM (SELECT *, row_number() OVER (PARTITION BY user_id, season ORDER BY n DESC, first) AS r FROM c) WHERE r = 1
    """
)
def primary_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("season", F.weekofyear("ts").cast("long"))
    return records.most_frequent(events, ["user_id", "season"], "event_type", F.struct("ts", "event_id"), "main")


@query(
    f"""
    WITH {LONG}, m AS (SELECT team AS member, season, day, max(cw) AS cw, max(cl) AS cl, max(ct) AS ct FROM (
        SELECT team, season, day, sum(win) OVER w AS cw, sum(loss) OVER w AS cl, sum(tie) OVER w AS ct FROM long
        WINDOW w AS (PARTITION BY team, season ORDER BY day, game_id)) GROUP BY 1, 2, 3),
    x AS (SELECT l.game_id, l.team, l.season, l.day, t.member FROM long l JOIN (SELECT range AS member FROM range({TEAMS})) t ON t.member % 8 = l.team % 8),
    j AS (SELECT x.*, coalesce(cw, 0) AS w, coalesce(cl, 0) AS l, coalesce(ct, 0) AS t FROM x ASOF LEFT JOIN m ON x.member = m.member AND x.season = m.season AND x.day > m.day),
    p AS (SELECT *, CASE WHEN w + l + t > 0 THEN CAST(w + 0.5 * t AS DOUBLE) / CAST(w + l + t AS DOUBLE) ELSE 0.5 END AS pct FROM j),
    r AS (SELECT *, rank() OVER (PARTITION BY game_id, team ORDER BY pct DESC) AS r, max(pct) OVER (PARTITION BY game_id, team) AS lead FROM p)
    SELECT game_id, team, CAST(r AS BIGINT) AS div_rank, round(lead - pct, 6) AS behind FROM r WHERE member = team
    """
)
def division_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long(spark, sf_dir)
    by = ["team", "season"]
    cum = rows.select(F.col("team").alias("member"), "season", "day", "game_id", *(ts.running_sum(c, by, ORDER).alias(f"c_{c}") for c in ("win", "loss", "tie")))
    members = spark.range(TEAMS).select(F.col("id").alias("member"), (F.col("id") % 8).alias("div"))
    x = records.members_of(rows.select("game_id", "team", "season", "day", (F.col("team") % 8).alias("div")), members, ["div"])
    got = strict_asof(x, cum, ["member", "season"], "day", "day", ["c_win", "c_loss", "c_tie"], ties=["game_id"])
    w, l, t = (F.coalesce(c, F.lit(0)) for c in ("c_win", "c_loss", "c_tie"))
    n = w + l + t
    got = got.withColumn("pct", F.coalesce(ratio(w + 0.5 * t, n), F.lit(0.5)))
    one = Window.partitionBy("game_id", "team")
    ranked = got.select("game_id", "team", "member", F.rank().over(one.orderBy(F.desc("pct"))).cast("long").alias("div_rank"), rnd(F.max("pct").over(one) - F.col("pct")).alias("behind"))
    return ranked.filter("member = team").select("game_id", "team", "div_rank", "behind")


@query(
    """
    WITH known AS (
        SELECT o.o_orderkey, l.l_partkey, l.l_shipdate, l.l_returnflag, l.l_linestatus, l.l_suppkey % 5 AS grp, l.l_linenumber
        FROM lineitem l JOIN (SELECT DISTINCT o_orderkey, o_orderdate FROM orders) o ON o.o_orderkey = l.l_orderkey
        WHERE l.l_shipdate < o.o_orderdate
    ), latest AS (
        SELECT o_orderkey, l_partkey, arg_max(l_returnflag, (l_shipdate, l_returnflag)) FILTER (l_returnflag IS NOT NULL) AS status, arg_max(grp, (l_shipdate, grp)) FILTER (grp IS NOT NULL) AS grp
        FROM known GROUP BY 1, 2
    ), counts AS (
        SELECT o_orderkey, count(*) FILTER (status = 'R') AS n_out, count(*) FILTER (status = 'A') AS n_doubtful, count(*) FILTER (status = 'N') AS n_questionable,
               count(*) FILTER (status IN ('R', 'A') AND grp = 0) AS od_0, count(*) FILTER (status IN ('R', 'A') AND grp = 1) AS od_1
        FROM latest GROUP BY 1
    ), covered AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM known JOIN orders USING (o_orderkey))
    SELECT o.o_orderkey, CASE WHEN v.m IS NOT NULL THEN coalesce(n_out, 0) END AS n_out, CASE WHEN v.m IS NOT NULL THEN coalesce(n_doubtful, 0) END AS n_doubtful,
           CASE WHEN v.m IS NOT NULL THEN coalesce(n_questionable, 0) END AS n_questionable, CASE WHEN v.m IS NOT NULL THEN coalesce(od_0, 0) END AS od_0, CASE WHEN v.m IS NOT NULL THEN coalesce(od_1, 0) END AS od_1
    FROM orders o LEFT JOIN counts c USING (o_orderkey) LEFT JOIN covered v ON v.m = CAST(date_trunc('month', o.o_orderdate) AS DATE)
    """
)
def knowledge_time_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_shipdate", "l_returnflag", (F.col("l_suppkey") % 5).alias("grp"))
    known = lines.join(orders.distinct(), "o_orderkey").filter("l_shipdate < o_orderdate")
    latest = records.latest_values(known, ["o_orderkey", "l_partkey"], "l_shipdate", ["l_returnflag", "grp"])
    status, both = F.col("l_returnflag"), F.col("l_returnflag").isin("R", "A")
    counts = latest.groupBy("o_orderkey").agg(
        F.count_if(status == "R").alias("n_out"),
        F.count_if(status == "A").alias("n_doubtful"),
        F.count_if(status == "N").alias("n_questionable"),
        *(F.count_if(both & (F.col("grp") == k)).alias(f"od_{k}") for k in (0, 1)),
    )
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    covered = known.select(month.alias("m")).distinct().withColumn("has", F.lit(True))
    rows = orders.withColumn("m", month).join(counts, "o_orderkey", "left").join(covered, "m", "left")
    return rows.select("o_orderkey", *(F.when(F.col("has"), F.coalesce(c, F.lit(0))).alias(c) for c in ("n_out", "n_doubtful", "n_questionable", "od_0", "od_1")))


@query(
    """
    WITH u AS (SELECT user_id, event_type, value, event_id, 0 AS s FROM events WHERE event_id % 3 = 0 UNION ALL SELECT user_id, event_type, -value, event_id, 1 FROM events)
    SELECT user_id, event_type, round(value, 6) AS value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS r FROM u) WHERE r = 1
    """
)
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    merged = records.first_source([events.filter("event_id % 3 = 0"), events.withColumn("value", -F.col("value"))], ["user_id", "event_type"], ["event_id"])
    return merged.select("user_id", "event_type", rnd(F.col("value")).alias("value"), "event_id")


@query(
    f"""
    WITH {GAMES}, open AS (SELECT day, home AS team FROM games WHERE home_score IS NULL UNION SELECT day, away FROM games WHERE home_score IS NULL),
    first AS (SELECT team, min(day) AS day FROM open GROUP BY 1)
    SELECT game_id, EXISTS (SELECT 1 FROM first f WHERE f.team IN (g.home, g.away) AND f.day < g.day) AS early FROM games g
    """
)
def early_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = games(spark, sf_dir)
    sides = rows.select("game_id", "day", "home_score", F.explode(F.array("home", "away")).alias("team"))
    # an earlier unplayed game exists if the team's first one is earlier: no range join
    first = F.min(F.when(F.col("home_score").isNull(), F.col("day"))).over(Window.partitionBy("team"))
    return sides.withColumn("e", truth(first < F.col("day"))).groupBy("game_id").agg(F.max("e").alias("early"))


# ---------------------------------------------------------------- expressions, sets, metrics

ODDS = f"""
{GAMES}, odds AS (
    SELECT game_id, home_score, away_score, home_score - away_score AS margin, CAST(game_id * 7 % 400 AS BIGINT) + 100 AS a,
           CASE WHEN game_id % 3 = 0 THEN -(CAST(game_id * 7 % 400 AS BIGINT) + 100) ELSE CAST(game_id * 7 % 400 AS BIGINT) + 100 END AS home_line,
           CASE WHEN game_id % 3 = 0 THEN CAST(game_id * 11 % 400 AS BIGINT) + 100 ELSE -(CAST(game_id * 11 % 400 AS BIGINT) + 100) END AS away_line,
           (game_id * 13 % 29) - 14 + 0.5 AS spread, (game_id * 17 % 23) - 11.0 AS predicted, season
    FROM games
), priced AS (
    SELECT *, CASE WHEN home_line < 0 THEN -home_line / (100.0 - home_line) ELSE 100.0 / (home_line + 100) END AS ph,
           CASE WHEN away_line < 0 THEN -away_line / (100.0 - away_line) ELSE 100.0 / (away_line + 100) END AS pa
    FROM odds
), probs AS (SELECT *, CAST(ph AS DOUBLE) / CAST(ph + pa AS DOUBLE) AS market, CAST(game_id * 37 % 997 AS DOUBLE) / 997 AS p FROM priced)"""


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("game_id")
    line = lambda k: (g * k % 400 + 100).cast("double")
    fav = g % 3 == 0
    rows = games(spark, sf_dir).withColumns(
        {
            "margin": F.col("home_score") - F.col("away_score"),
            "home_line": F.when(fav, -line(7)).otherwise(line(7)),
            "away_line": F.when(fav, line(11)).otherwise(-line(11)),
            "spread": (g * 13 % 29).cast("double") - 14 + 0.5,
            "predicted": (g * 17 % 23).cast("double") - 11.0,
            "p": (g * 37 % 997).cast("double") / 997,
        }
    )
    return rows.withColumn("market", no_vig(F.col("home_line"), F.col("away_line")))


@query(f"WITH {ODDS} SELECT game_id, round(CAST(ph AS DOUBLE), 6) AS home_implied, round(market, 6) AS home_no_vig FROM probs")
def novig_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odds(spark, sf_dir).select("game_id", rnd(implied_probability(F.col("home_line"))).alias("home_implied"), rnd(F.col("market")).alias("home_no_vig"))


@query(
    f"""
    WITH {GAMES} SELECT game_id, home - away AS diff_team, CAST(home_score > away_score AS BIGINT) AS won, 1 AS home_adv FROM games WHERE home_score <> away_score
    UNION ALL SELECT game_id, away - home, CAST(home_score < away_score AS BIGINT), -1 FROM games WHERE home_score <> away_score
    """
)
def orientation_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridstone.plans.models import augmented

    rows = games(spark, sf_dir).filter("home_score <> away_score").select("game_id", (F.col("home") - F.col("away")).alias("diff_team"), (F.col("home_score") > F.col("away_score")).cast("long").alias("won"), F.lit(1).alias("home_adv"))
    return augmented(rows, ["diff_team", "home_adv"], label="won")


WON = "CAST(margin > 0 AS DOUBLE)"


@query(
    f"""
    WITH {ODDS}, c AS (SELECT *, {WON} AS won, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM probs WHERE margin <> 0)
    SELECT season, CAST(count(*) AS BIGINT) AS n, round(avg(CAST((p > 0.5) = (won > 0.5) AS DOUBLE)), 6) AS accuracy, round(avg(-(won * ln(q) + (1 - won) * ln(1 - q))), 6) AS log_loss, round(avg((p - won) * (p - won)), 6) AS brier
    FROM c GROUP BY season
    """
)
def win_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = odds(spark, sf_dir).filter("margin <> 0").withColumn("won", (F.col("margin") > 0).cast("double"))
    out = rows.groupBy("season").agg(*metrics.win_metrics(F.col("p"), F.col("won")))
    return out.select("season", "n", *(rnd(F.col(c)).alias(c) for c in ("accuracy", "log_loss", "brier")))


@query(
    f"""
    WITH {ODDS} SELECT season, round(avg(abs(predicted - margin)), 6) AS mae, round(sqrt(avg((predicted - margin) * (predicted - margin))), 6) AS rmse
    FROM probs WHERE margin IS NOT NULL GROUP BY season
    """
)
def margin_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = odds(spark, sf_dir).filter("margin is not null").groupBy("season").agg(*metrics.margin_metrics(F.col("predicted"), F.col("margin").cast("double")))
    return rows.select("season", rnd(F.col("mae")).alias("mae"), rnd(F.col("rmse")).alias("rmse"))


@query(
    f"""
    WITH {ODDS}, c AS (SELECT *, {WON} AS won, greatest(p, 1 - p) AS conf FROM probs WHERE margin <> 0),
    b(lo, hi) AS (VALUES {", ".join(f"({lo}, {hi})" for lo, hi in metrics.BINS)})
    SELECT format('({{:.2f}}, {{:.2f}}]', CAST(lo AS DOUBLE), CAST(hi AS DOUBLE)) AS bin, CAST(count(*) AS BIGINT) AS games, round(avg(CAST((p > 0.5) = (won > 0.5) AS DOUBLE)), 6) AS accuracy,
           round(avg(conf), 6) AS confidence, round(avg(CAST((market > 0.5) = (won > 0.5) AS DOUBLE)), 6) AS market
    FROM c JOIN b ON conf > lo AND conf <= hi GROUP BY lo, hi
    """
)
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = odds(spark, sf_dir).filter("margin <> 0").withColumn("won", (F.col("margin") > 0).cast("double"))
    out = metrics.confidence_buckets(rows, F.col("p"), F.col("won"), F.col("market"))
    return out.select("bin", "games", *(rnd(F.col(c)).alias(c) for c in ("accuracy", "confidence", "market")))


@query(
    f"""
    WITH {ODDS}, c AS (SELECT *, {WON} AS won, (p > 0.5) <> (market > 0.5) AS differ FROM probs WHERE margin <> 0)
    SELECT season, round(avg(CAST(NOT differ AS DOUBLE)), 6) AS agreement, CAST(count(*) FILTER (differ) AS BIGINT) AS disagreements,
           round(avg(CAST((p > 0.5) = (won > 0.5) AS DOUBLE)) FILTER (differ), 6) AS ours, round(avg(CAST((market > 0.5) = (won > 0.5) AS DOUBLE)) FILTER (differ), 6) AS markets
    FROM c GROUP BY season
    """
)
def market_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = odds(spark, sf_dir).filter("margin <> 0").withColumn("won", (F.col("margin") > 0).cast("double"))
    out = rows.groupBy("season").agg(*metrics.agreement(F.col("p"), F.col("market"), F.col("won")))
    return out.select("season", "disagreements", *(rnd(F.col(c)).alias(c) for c in ("agreement", "ours", "markets")))


@query(
    f"""
    WITH {ODDS}, c AS (SELECT *, predicted - spread AS edge, margin - spread AS result FROM probs WHERE margin IS NOT NULL)
    SELECT season, CAST(count(*) FILTER (result <> 0 AND edge <> 0) AS BIGINT) AS bets, round(avg(CAST((edge > 0) = (result > 0) AS DOUBLE)) FILTER (result <> 0 AND edge <> 0), 6) AS hit_rate,
           CAST(count(*) FILTER (result <> 0 AND edge <> 0 AND abs(edge) > 1.5) AS BIGINT) AS big_bets, round(avg(CAST((edge > 0) = (result > 0) AS DOUBLE)) FILTER (result <> 0 AND edge <> 0 AND abs(edge) > 1.5), 6) AS big_hit_rate
    FROM c GROUP BY season
    """
)
def ats_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = odds(spark, sf_dir).filter("margin is not null")
    out = rows.groupBy("season").agg(*metrics.against_the_spread(F.col("predicted") - F.col("spread"), F.col("margin") - F.col("spread")))
    return out.select("season", "bets", rnd(F.col("hit_rate")).alias("hit_rate"), "big_bets", rnd(F.col("big_hit_rate")).alias("big_hit_rate"))


@query(
    """
    SELECT d.lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(l.quality) AS BIGINT) AS good, CAST(sum(d.n_chars) AS BIGINT) AS chars FROM documents d JOIN labels l USING (doc_id) GROUP BY 1
    """
)
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.one_to_one(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), load(spark, sf_dir, "labels"), ["doc_id"])
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("n_chars").alias("chars"))


# ---------------------------------------------------------------- folds, verification, models


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games(spark, sf_dir)
    at = F.unix_date("day").cast("long")
    return elo(g.select(F.lit("league").alias("league"), "game_id", at.alias("at"), "season", "home", "away", F.lit(False).alias("neutral"), (F.col("home_score") - F.col("away_score")).cast("double").alias("margin")))


#: One game a step; the state is the teams' ratings and the seasons in which they were last used.
ELO = (
    GAMES
    + f""",
ordered AS (
    SELECT game_id, season, home, away, home_score - away_score AS margin, row_number() OVER (ORDER BY day, game_id) AS i FROM games
), listed AS MATERIALIZED (
    SELECT list(ordered ORDER BY i) AS l FROM ordered
), fold AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS game_id, list_transform(range({TEAMS}), lambda k: CAST(1500 AS DOUBLE)) AS r, list_transform(range({TEAMS}), lambda k: CAST(NULL AS BIGINT)) AS s,
           CAST(NULL AS DOUBLE) AS h, CAST(NULL AS DOUBLE) AS a
    UNION ALL
    SELECT i, game_id, list_transform(range({TEAMS}), lambda k: CASE WHEN k = home THEN h + gain WHEN k = away THEN a - gain ELSE r[k + 1] END),
           list_transform(range({TEAMS}), lambda k: CASE WHEN k = home OR k = away THEN season ELSE s[k + 1] END), h, a
    FROM (
        SELECT *, CASE WHEN margin IS NULL THEN 0 ELSE 20 * CASE WHEN margin = 0 THEN 1 ELSE 2.2 * ln(1 + abs(margin)) / (2.2 + 0.001 * sign(margin) * (h - a + 65)) END
                  * ((sign(margin) + 1) / 2.0 - 1 / (1 + pow(10.0, (a - h - 65) / 400))) END AS gain
        FROM (
            SELECT o.*, r[home + 1] + CASE WHEN s[home + 1] <> season THEN (1500 - r[home + 1]) / 3 ELSE 0 END AS h,
                   r[away + 1] + CASE WHEN s[away + 1] <> season THEN (1500 - r[away + 1]) / 3 ELSE 0 END AS a
            FROM (SELECT unnest(l[i + 1]), r, s FROM (SELECT i, r, s FROM fold WHERE i < (SELECT count(*) FROM orders)) CROSS JOIN listed) o
        )
    )
)"""
)


@query(f"WITH RECURSIVE {ELO} SELECT game_id, round(h, 4) AS home_elo, round(a, 4) AS away_elo FROM fold WHERE i > 0")
def elo_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).select("game_id", rnd(F.col("home_elo"), 4).alias("home_elo"), rnd(F.col("away_elo"), 4).alias("away_elo"))


@query(
    f"""
    WITH RECURSIVE {ELO}, met AS (
        SELECT g.game_id, day, season, home AS team, a AS elo, CAST(home_score IS NOT NULL AS BIGINT) AS played FROM games g JOIN fold f ON f.game_id = g.game_id
        UNION ALL SELECT g.game_id, day, season, away, h, CAST(home_score IS NOT NULL AS BIGINT) FROM games g JOIN fold f ON f.game_id = g.game_id
    )
    SELECT game_id, team, round(CASE WHEN sum(played) OVER w > 0 THEN sum(elo * played) OVER w / CAST(sum(played) OVER w AS DOUBLE) END, 4) AS avg_opp_elo
    FROM met WINDOW w AS (PARTITION BY team, season ORDER BY day, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """
)
def schedule_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["team", "season"]
    rows = long(spark, sf_dir).join(rated(spark, sf_dir).drop("league"), "game_id")
    rows = rows.withColumn("opp_elo", F.when(F.col("is_home") == 1, F.col("away_elo")).otherwise(F.col("home_elo")))
    return rows.select("game_id", "team", rnd(ratio(ts.prior_sum(F.col("opp_elo") * F.col("played"), by, ORDER), ts.prior_sum("played", by, ORDER)), 4).alias("avg_opp_elo"))


@query(
    """
    SELECT * FROM (VALUES ('clean', CAST(0 AS BIGINT)), ('control', CAST(1 AS BIGINT))) t(build, leaks)
    """
)
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features before a cutoff, built from clean and from corrupted games: no difference, but for the build that leaks."""
    from gridstone.plans.verification import corrupted, differences

    rows = games(spark, sf_dir)
    cutoff = F.to_date(F.lit("1998-07-01"))
    bad = corrupted(rows, F.col("day") >= cutoff, ["game_id"], ["home_score", "away_score"])
    by = ["home"]

    def features(df: DataFrame, leaky: bool) -> DataFrame:
        diff = F.coalesce(F.col("home_score") - F.col("away_score"), F.lit(0))
        value = F.sum(diff).over(Window.partitionBy(*by)) if leaky else ts.prior_sum(diff, by, ORDER)
        return df.select("game_id", "day", value.cast("double").alias("form")).filter(F.col("day") < cutoff).drop("day")

    def leaks(leaky: bool, name: str) -> DataFrame:
        found = differences(features(rows, leaky), features(bad, leaky), ["game_id"], ["form"])
        return found.agg((F.sum("mismatches") > 0).cast("long").alias("leaks")).select(F.lit(name).alias("build"), "leaks")

    return leaks(False, "clean").unionByName(leaks(True, "control"))
