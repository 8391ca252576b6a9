"""Reference SQL for the queries, written for DuckDB over the driver's views.

The statements state the semantics directly (folds over ordered lists, full
cross products, row-wise closed forms) and share no shortcut with the Spark
operators.
"""

from __future__ import annotations

from assetloom.operators.indicators import features
from checks.queries import CUTOFFS, DROP, EARLY, FIRST, HALF_UP, LAST, LATER, LATEST, LOOKBACK, MIDDLE, NEGATIVES, NUM_FUTURE, NUM_SPLIT, SEED

LONG, SHORT = (21, 63, 126, 189), (21, 63, 126)
PRIME = 2147483647
_SQL: dict[str, str] = {}

DAY = "CAST(l_shipdate AS DATE)"
WEEK = "CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE)"
BRAND = "p_brand"
BRANDTYPE = "p_brand || '/' || p_type"


def r(expr: str, n: int) -> str:
    scale = f"{10.0**n!r}::DOUBLE"
    return f"(floor(({expr}) * {scale} + {HALF_UP}::DOUBLE) / {scale})"


def prices(item: str = BRANDTYPE, grain: str = WEEK) -> str:
    return f"""prices AS (
  SELECT {item} AS col_item, {grain} AS col_timestamp, sum(l_extendedprice) / sum(l_quantity) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


DAILY = prices(BRAND, DAY)
TRADES = f"""trades AS (
  SELECT o_custkey AS col_user, {BRANDTYPE} AS col_item,
         CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS col_rating,
         {WEEK} AS col_timestamp, l_quantity AS units, l_extendedprice AS value, l_orderkey,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
                            l_extendedprice, l_discount, l_tax) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
QUOTES = f"""quotes AS (
  SELECT {BRANDTYPE} AS col_item, {WEEK} AS col_timestamp,
         CASE WHEN l_discount = 0.0 AND l_quantity = 1.0 THEN 0.0 ELSE l_extendedprice / l_quantity END AS price,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                            l_extendedprice, l_discount, l_tax) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
STEPS = NUM_SPLIT + NUM_FUTURE
POINTS = """days AS (
  SELECT DISTINCT col_timestamp AS d FROM prices WHERE col_timestamp BETWEEN DATE '{first}' AND DATE '{last}'),
ranked AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM days),
points AS (
  SELECT i, d, r FROM range(0, {steps} + 1) t(i)
  JOIN ranked ON r = CASE WHEN i < {steps} THEN i * (n // {steps}) ELSE n - 1 END)"""
GRID = (
    POINTS.format(first=FIRST, last=LAST, steps=STEPS)
    + f""",
splits AS (
  SELECT CAST(a.i AS INTEGER) AS split_id, a.d AS rec_date, b.d AS future_date
  FROM points a JOIN points b ON b.i = a.i + {NUM_FUTURE})"""
)
SETS = f"""train AS (
  SELECT split_id, col_user, col_item, max(col_rating) AS col_rating, min(col_timestamp) AS col_timestamp
  FROM trades JOIN splits ON col_timestamp < rec_date GROUP BY 1, 2, 3),
raw_test AS (
  SELECT split_id, col_user, col_item, max(col_rating) AS col_rating, min(col_timestamp) AS col_timestamp
  FROM trades JOIN splits ON col_timestamp BETWEEN rec_date AND future_date
  GROUP BY 1, 2, 3),
warm AS (
  SELECT * FROM raw_test t
  WHERE EXISTS (SELECT 1 FROM train a WHERE a.split_id = t.split_id AND a.col_user = t.col_user)
    AND EXISTS (SELECT 1 FROM train a WHERE a.split_id = t.split_id AND a.col_item = t.col_item)),
test AS (
  SELECT * FROM warm t
  WHERE NOT EXISTS (SELECT 1 FROM train a WHERE a.split_id = t.split_id AND a.col_user = t.col_user
                    AND a.col_item = t.col_item)),
ends AS (
  SELECT split_id, max(col_timestamp) AS d FROM prices JOIN splits ON col_timestamp <= future_date GROUP BY 1),
at_end AS (SELECT DISTINCT split_id, col_item FROM prices JOIN ends ON col_timestamp = d),
priced AS (
  SELECT split_id, col_item FROM at_end
  INTERSECT SELECT split_id, col_item FROM prices JOIN splits ON col_timestamp = rec_date),
full_test AS (SELECT split_id, col_item FROM at_end INTERSECT SELECT split_id, col_item FROM test)"""
BASE = f"{prices()}, {GRID}"
FULL = f"{BASE}, {TRADES}, {SETS}"


def add(name: str, ctes: str, body: str) -> None:
    _SQL[name] = f"WITH RECURSIVE {ctes}\n{body}" if ctes else body


def add_plain(name: str, ctes: str, body: str) -> None:
    """Without recursion, every intermediate table computed once."""
    _SQL[name] = f"WITH {ctes.replace(' AS (', ' AS MATERIALIZED (')}\n{body}"


# ------------------------------------------------------------------ A sources
add("src_interactions", TRADES, "SELECT col_user, col_item, col_rating, col_timestamp FROM trades")
add("src_prices", DAILY, f"SELECT col_item, col_timestamp, {r('price', 4)} AS price FROM prices")
LIMITS = """limits AS (
  SELECT col_item, min(col_timestamp) AS min_date, max(col_timestamp) AS max_date,
         arg_min(price, col_timestamp) AS price_min_date, arg_max(price, col_timestamp) AS price_max_date
  FROM prices GROUP BY 1)"""
add(
    "limit_prices",
    f"{prices()}, {LIMITS}",
    f"""SELECT col_item, min_date, max_date, {r('price_min_date', 4)} AS price_min_date,
  {r('price_max_date', 4)} AS price_max_date,
  {r('(price_max_date - price_min_date) / price_min_date', 6)} AS roi FROM limits""",
)

# ----------------------------------------------------------------- B cleaning
add(
    "clean_zero_assets",
    QUOTES,
    f"""SELECT col_item, col_timestamp, {r('price', 4)} AS price FROM quotes
WHERE col_item NOT IN (SELECT col_item FROM quotes WHERE price = 0)""",
)
add(
    "clean_dedup_last",
    QUOTES,
    f"""SELECT col_item, col_timestamp, {r('price', 4)} AS price FROM quotes
QUALIFY row_number() OVER (PARTITION BY col_item, col_timestamp ORDER BY seq DESC) = 1""",
)
add(
    "price_slice",
    DAILY,
    f"""SELECT col_item, col_timestamp, {r('price', 4)} AS price FROM prices
WHERE col_timestamp >= DATE '{FIRST}' AND col_timestamp <= DATE '{LATER}'""",
)
PAIRS = """pairs AS (
  SELECT col_user, col_item, CASE WHEN sum(col_rating) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS col_rating,
         min(col_timestamp) AS col_timestamp
  FROM trades GROUP BY 1, 2)"""
add("collapse_pairs", f"{TRADES}, {PAIRS}", "SELECT * FROM pairs")
RATING_COLUMNS = "col_user, col_item, col_rating, col_timestamp"
add(
    "warm_test",
    TRADES,
    f"""SELECT {RATING_COLUMNS} FROM trades WHERE col_timestamp >= DATE '{EARLY}'
  AND col_user IN (SELECT col_user FROM trades WHERE col_timestamp < DATE '{EARLY}')
  AND col_item IN (SELECT col_item FROM trades WHERE col_timestamp < DATE '{EARLY}')""",
)
add(
    "novel_test",
    TRADES,
    f"""SELECT {RATING_COLUMNS} FROM trades t WHERE col_timestamp >= DATE '{LATER}'
  AND NOT EXISTS (SELECT 1 FROM trades a WHERE a.col_timestamp < DATE '{LATER}'
                  AND a.col_user = t.col_user AND a.col_item = t.col_item)""",
)
add("flt_customer_in_train", FULL, "SELECT DISTINCT split_id, col_user FROM train")
add("flt_asset_full_test", FULL, "SELECT split_id, col_item FROM full_test")
add("flt_asset_test_price", FULL, "SELECT split_id, col_item FROM priced")
FRESH = """fresh AS (
  SELECT t.* FROM warm t
  WHERE (split_id, col_user) IN (SELECT split_id, col_user FROM train)
    AND (split_id, col_user, col_item) NOT IN (SELECT split_id, col_user, col_item FROM train))"""
SPLIT_COLUMNS = f"split_id, {RATING_COLUMNS}"
add_plain(
    "flt_ratings_not_in_train",
    FULL,
    f"""SELECT {SPLIT_COLUMNS} FROM warm
  SEMI JOIN (SELECT DISTINCT split_id, col_user FROM train) u USING (split_id, col_user)
  ANTI JOIN train a USING (split_id, col_user, col_item)""",
)
add(
    "data_filter",
    f"{FULL}, {FRESH}",
    f"""SELECT 'train' AS part, {SPLIT_COLUMNS} FROM train
  WHERE (split_id, col_item) IN (SELECT split_id, col_item FROM priced)
UNION ALL SELECT 'test', {SPLIT_COLUMNS} FROM fresh
  WHERE (split_id, col_item) IN (SELECT split_id, col_item FROM priced)
    AND (split_id, col_user) IN (SELECT split_id, col_user FROM train)""",
)
add(
    "binarize",
    TRADES,
    """SELECT col_user, col_item, CASE WHEN units > 10 THEN 1.0::DOUBLE ELSE units END AS col_rating, col_timestamp
FROM trades""",
)
add(
    "normalize_ratings",
    TRADES,
    f"""SELECT CASE WHEN col_timestamp < DATE '{LATER}' THEN 'train' ELSE 'test' END AS part, col_user, col_item,
  {r(f"units / (SELECT max(units) FROM trades WHERE col_timestamp < DATE '{LATER}')", 6)} AS col_rating,
  col_timestamp FROM trades""",
)
add(
    "intersect_stats",
    f"""{TRADES}, kept AS (
  SELECT * FROM trades WHERE col_timestamp >= DATE '{LATER}'
  AND col_user IN (SELECT col_user FROM trades WHERE col_timestamp < DATE '{LATER}')
  AND col_item IN (SELECT col_item FROM trades WHERE col_timestamp < DATE '{LATER}'))""",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(DISTINCT {c}) AS nunique FROM kept"
        for c in ("col_user", "col_item", "col_rating", "col_timestamp")
    ),
)
INDEX = f"""{TRADES}, {PAIRS},
users AS (
  SELECT col_user, row_number() OVER (ORDER BY substr(md5(CAST(col_user AS VARCHAR)), 1, 3), col_user) - 1 AS user_idx
  FROM (SELECT DISTINCT col_user FROM pairs)),
items AS (
  SELECT col_item, row_number() OVER (ORDER BY substr(md5(col_item), 1, 3), col_item) - 1 AS item_idx
  FROM (SELECT DISTINCT col_item FROM pairs)),
edges AS (SELECT * FROM pairs JOIN users USING (col_user) JOIN items USING (col_item))"""
add("reindex", INDEX, "SELECT col_user, col_item, user_idx, item_idx FROM edges")
POSITIVES = """positives AS (
  SELECT DISTINCT split_id, col_user, col_item FROM test
  WHERE col_rating > 0 AND (split_id, col_item) IN (SELECT split_id, col_item FROM priced))"""
add("positive_assets", f"{FULL}, {POSITIVES}", "SELECT * FROM positives")

# ------------------------------------------------------------------- C splits
add("date_grid", BASE, "SELECT * FROM splits")
add(
    "date_grid_frac",
    f"""{prices()}, {POINTS.format(first=FIRST, last=LAST, steps=NUM_SPLIT + 2)},
spans AS (
  SELECT a.i, a.d, b.r AS lo, c.r AS hi
  FROM points a JOIN points b ON b.i = a.i + 1 JOIN points c ON c.i = a.i + 2)""",
    """SELECT CAST(i AS INTEGER) AS split_id, s.d AS rec_date, k.d AS future_date
FROM spans s JOIN ranked k ON k.r = lo + greatest(1, CAST(floor(0.5 * (hi - lo + 1)) AS BIGINT))""",
)
add(
    "split_two_way",
    FULL,
    f"SELECT {SPLIT_COLUMNS}, 'train' AS part FROM train UNION ALL SELECT {SPLIT_COLUMNS}, 'test' FROM test",
)


def chain(bounds: list, names: list[str]) -> str:
    parts, lower = [], None
    for end, name in zip(bounds, names, strict=True):
        low = f"col_timestamp >= DATE '{lower}' AND " if lower else ""
        old = (
            f"""AND NOT EXISTS (SELECT 1 FROM trades a WHERE a.col_timestamp < DATE '{lower}'
              AND a.col_user = t.col_user AND a.col_item = t.col_item)"""
            if lower
            else ""
        )
        parts.append(
            f"""SELECT col_user, col_item, max(col_rating) AS col_rating, min(col_timestamp) AS col_timestamp,
  '{name}' AS part FROM trades t WHERE {low}col_timestamp < DATE '{end}' {old} GROUP BY 1, 2"""
        )
        lower = end
    return "\nUNION ALL ".join(parts)


add("split_valid", TRADES, chain([MIDDLE, LATER], ["train", "valid"]))
add("split_three_way", TRADES, chain([MIDDLE, LATER, LATEST], ["train", "valid", "test"]))
add_plain(
    "split_dataset",
    FULL,
    """SELECT 'prices' AS part, split_id, col_item, CAST(NULL AS BIGINT) AS col_user, col_timestamp
FROM full_test JOIN splits USING (split_id) JOIN prices USING (col_item) WHERE col_timestamp <= future_date
UNION ALL SELECT 'train', split_id, col_item, col_user, col_timestamp FROM train
UNION ALL SELECT 'test', split_id, col_item, col_user, col_timestamp FROM test""",
)


add_plain(
    "split_lookback",
    f"""{BASE}, {TRADES},
bounded AS (
  SELECT split_id, col_user, col_item, col_timestamp < rec_date AS early, max(col_rating) AS col_rating,
         min(col_timestamp) AS col_timestamp
  FROM trades JOIN splits ON col_timestamp >= rec_date - {LOOKBACK} AND col_timestamp <= future_date
  GROUP BY 1, 2, 3, 4),
train AS (SELECT * FROM bounded WHERE early)""",
    f"""SELECT 'train' AS part, {SPLIT_COLUMNS} FROM train
UNION ALL SELECT 'test', {SPLIT_COLUMNS} FROM (SELECT * FROM bounded WHERE NOT early)
  SEMI JOIN (SELECT DISTINCT split_id, col_user FROM train) u USING (split_id, col_user)
  SEMI JOIN (SELECT DISTINCT split_id, col_item FROM train) i USING (split_id, col_item)
  ANTI JOIN train a USING (split_id, col_user, col_item)""",
)


def window_set(name: str, low: str, high: str) -> str:
    return f"""{name} AS (
  SELECT split_id, col_user, col_item, max(col_rating) AS col_rating, min(col_timestamp) AS col_timestamp
  FROM trades JOIN three ON {low} AND {high} GROUP BY 1, 2, 3)"""


def clean(name: str, source: str, known: str) -> str:
    return f"""{name} AS (
  SELECT * FROM {source} t
  WHERE EXISTS (SELECT 1 FROM {known} a WHERE a.split_id = t.split_id AND a.col_user = t.col_user)
    AND EXISTS (SELECT 1 FROM {known} a WHERE a.split_id = t.split_id AND a.col_item = t.col_item)
    AND NOT EXISTS (SELECT 1 FROM {known} a WHERE a.split_id = t.split_id AND a.col_user = t.col_user
                    AND a.col_item = t.col_item))"""


def later_users(name: str, source: str, known: str) -> str:
    return f"""{name} AS (
  SELECT * FROM {source} t
  WHERE EXISTS (SELECT 1 FROM {known} a WHERE a.split_id = t.split_id AND a.col_user = t.col_user)
    AND NOT EXISTS (SELECT 1 FROM {known} a WHERE a.split_id = t.split_id AND a.col_user = t.col_user
                    AND a.col_item = t.col_item))"""


add(
    "split_with_valid",
    ", ".join(
        [
            BASE,
            TRADES,
            """three AS (SELECT b.split_id, a.rec_date AS valid_date, b.rec_date, b.future_date
  FROM splits a JOIN splits b ON b.split_id = a.split_id + 1)""",
            window_set("w_train", "TRUE", "col_timestamp < valid_date"),
            window_set("w_valid", "col_timestamp >= valid_date", "col_timestamp <= rec_date"),
            window_set("w_mid", "col_timestamp >= valid_date", "col_timestamp < rec_date"),
            window_set("w_test", "col_timestamp >= rec_date", "col_timestamp <= future_date"),
            clean("valid", "w_valid", "w_train"),
            clean("test_a", "w_test", "w_mid"),
            later_users("test_b", "test_a", "w_train"),
            later_users("test_c", "test_b", "valid"),
        ]
    ),
    f"""SELECT 'train' AS part, {SPLIT_COLUMNS} FROM w_train
UNION ALL SELECT 'valid', {SPLIT_COLUMNS} FROM valid UNION ALL SELECT 'test', {SPLIT_COLUMNS} FROM test_c""",
)

# --------------------------------------------------------------- D indicators
SERIES = "PARTITION BY col_item ORDER BY col_timestamp"


def frame(t: int) -> str:
    return f"({SERIES} ROWS BETWEEN {t - 1} PRECEDING AND CURRENT ROW)"


def guarded(agg: str, x: str, t: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(t)} = {t} THEN {agg}({x}) OVER {frame(t)} END"


def lag(t: int) -> str:
    return f"lag(price, {t}) OVER ({SERIES})"


def ret(t: int) -> str:
    return f"(price - {lag(t)}) / {lag(t)}"


PRICE4 = f"{r('price', 4)} AS price"
RETURNS1 = f"returns AS (SELECT *, {ret(1)} AS r1, row_number() OVER ({SERIES}) - 1 AS i FROM prices)"
VOL = {t: f"{guarded('stddev_samp', 'r1', t)} * sqrt(252)" for t in LONG}


def table(columns: list[str], source: str = "prices", first: str = PRICE4) -> str:
    return f"SELECT col_item, col_timestamp, {first}, {', '.join(columns)} FROM {source}"


add("ind_avg_price", DAILY, table([f"{r(guarded('avg', 'price', t), 4)} AS avg_price_{t}d" for t in LONG]))
add("ind_roi", DAILY, table([f"{r(ret(t), 6)} AS past_profitability_{t}d" for t in (1, *LONG)]))
add("ind_volatility", f"{DAILY}, {RETURNS1}", table([f"{r(VOL[t], 6)} AS volatility_{t}d" for t in LONG], "returns"))
add(
    "ind_volatility_expanding",
    f"{DAILY}, {RETURNS1}",
    table(
        [
            r(
                f"""CASE WHEN count(r1) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) >= 2
    THEN stddev_samp(r1) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) END * sqrt(252)""",
                6,
            )
            + " AS volatility"
        ],
        "returns",
    ),
)


def sharpe(t: int) -> str:
    return f"coalesce(({ret(t)}) / nullif({VOL[t]}, 0), 0.0)"


add("ind_sharpe", f"{DAILY}, {RETURNS1}", table([f"{r(sharpe(t), 6)} AS sharpe_{t}d" for t in LONG], "returns"))


def ema(x: str, span: int, adjust: bool = False) -> str:
    """Row-wise closed form of the recursion."""
    alpha = 2.0 / (span + 1)
    q = 1 - alpha
    weight = "1.0" if adjust else f"(CASE WHEN i = 0 THEN 1.0 ELSE {alpha!r} END)"
    total = f"sum({weight} * ({x}) * pow({q!r}, -i)) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) * pow({q!r}, i)"
    return f"({total}) / ((1 - pow({q!r}, i + 1)) / {alpha!r})" if adjust else f"({total})"


add("ind_ema", f"{DAILY}, {RETURNS1}", table([f"{r(ema('price', s), 4)} AS ema_{s}" for s in (12, 26)], "returns"))
SPANS = (2, 12, 189, 500)
add(
    "ind_ema_spans",
    f"""{DAILY}, numbered AS (SELECT *, row_number() OVER ({SERIES}) - 1 AS i FROM prices),
walked AS (
  SELECT col_item, col_timestamp, price, i, {', '.join(f'price AS y{s}, price AS n{s}, 1.0::DOUBLE AS d{s}' for s in SPANS)}
  FROM numbered WHERE i = 0
  UNION ALL
  SELECT n.col_item, n.col_timestamp, n.price, n.i, {', '.join(
      f"(1 - {2.0 / (s + 1)!r}) * y{s} + {2.0 / (s + 1)!r} * n.price, {1 - 2.0 / (s + 1)!r} * n{s} + n.price, {1 - 2.0 / (s + 1)!r} * d{s} + 1"
      for s in SPANS)}
  FROM walked w JOIN numbered n ON n.col_item = w.col_item AND n.i = w.i + 1)""",
    table(
        [f"{r(f'y{s}', 4)} AS ema_{s}" for s in SPANS] + [f"{r(f'n{s} / d{s}', 4)} AS adj_{s}" for s in SPANS], "walked"
    ),
)
MACD = f"{ema('price', 12)} - {ema('price', 26)}"
add("ind_macd", f"{DAILY}, {RETURNS1}", table([f"{r(MACD, 4)} AS MACD"], "returns"))
add("ind_momentum", DAILY, table([f"{r(f'price - {lag(t)}', 4)} AS m_{t}d" for t in LONG]))
add("ind_roc", DAILY, table([f"{r(f'(price - {lag(t)}) / {lag(t)}', 6)} AS roc_{t}d" for t in LONG]))
MOVES = f"""moves AS (
  SELECT *, greatest(coalesce(price - p1, 0), 0) AS gain, greatest(coalesce(p1 - price, 0), 0) AS loss
  FROM (SELECT *, {lag(1)} AS p1 FROM returns)),
strength AS (SELECT *, {ema('gain', 14)} AS up, {ema('loss', 14)} AS down FROM moves)"""
RSI = "CASE WHEN down = 0 THEN (CASE WHEN up > 0 THEN 100.0 ELSE 0.0 END) ELSE 100 - 100 / (1 + up / down) END"
add("ind_rsi", f"{DAILY}, {RETURNS1}, {MOVES}", table([f"{r(RSI, 6)} AS rsi_14"], "strength"))
DCO = f"{lag(12)} - ({guarded('avg', 'price', 22)})"
add("ind_dco", DAILY, table([f"{r(DCO, 4)} AS dco_22"]))
add(
    "ind_min_max",
    DAILY,
    table([f"{r(guarded(k, 'price', t), 4)} AS {k}_{t}d" for t in LONG for k in ("min", "max")]),
)
add(
    "ind_exp_mean",
    f"{DAILY}, {RETURNS1}",
    table([f"{r(ema('price', t, True), 4)} AS exp_mean_{t}d" for t in LONG], "returns"),
)
add(
    "ind_smoothing",
    f"{DAILY}, averaged AS (SELECT *, {guarded('avg', 'price', 21)} AS avg_price_21d FROM prices)",
    table(
        [f"{r(guarded('avg', 'avg_price_21d', 5), 4)} AS avg_price_21d"],
        "averaged",
        f"{r(guarded('avg', 'price', 5), 4)} AS price",
    ),
)


def kpis(periods: tuple[int, ...], base: str = DAILY) -> tuple[str, list[str]]:
    columns = {
        **{f"avg_price_{t}d": guarded("avg", "price", t) for t in periods},
        **{f"past_profitability_{t}d": ret(t) for t in (1, *periods)},
        **{f"volatility_{t}d": VOL[t] for t in periods},
        "MACD": MACD,
        **{f"m_{t}d": f"price - {lag(t)}" for t in periods},
        **{f"roc_{t}d": f"(price - {lag(t)}) / {lag(t)}" for t in periods},
        "rsi_14": RSI,
        "dco_22": DCO,
        **{f"sharpe_{t}d": sharpe(t) for t in periods},
        **{f"{k}_{t}d": guarded(k, "price", t) for t in periods for k in ("min", "max")},
        **{f"exp_mean_{t}d": ema("price", t, True) for t in periods},
    }
    names = ["price", *columns]
    wide = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    smooth = ", ".join(f"{guarded('avg', n, 5)} AS {n}" for n in names)
    ctes = f"""{base}, {RETURNS1}, {MOVES},
wide AS (SELECT col_item, col_timestamp, price, {wide} FROM strength),
smooth AS (SELECT col_item, col_timestamp, {smooth} FROM wide)"""
    return ctes, names


for _name, _periods in (("kpi_full", LONG), ("kpi_short", SHORT)):
    _ctes, _names = kpis(_periods)
    add(
        _name,
        _ctes,
        f"""SELECT col_item, col_timestamp, {', '.join(f'{r(n, 4)} AS {n}' for n in _names)} FROM smooth
WHERE {' AND '.join(f'{n} IS NOT NULL' for n in _names)}""",
    )


def basic(periods: tuple[int, ...]) -> str:
    columns = {
        **{f"past_profitability_{t}d": ret(t) for t in (1, *periods)},
        **{f"volatility_{t}d": VOL[t] for t in periods},
    }
    wide = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    smooth = ", ".join(f"{guarded('avg', n, 5)} AS {n}" for n in ("price", *columns))
    return f"""{RETURNS1},
wide AS (SELECT col_item, col_timestamp, price, {wide} FROM returns),
kpis AS (SELECT col_item, col_timestamp, {smooth} FROM wide)"""


add(
    "kpi_basic",
    f"{DAILY}, {basic(LONG)}",
    table(
        [f"{r(f'past_profitability_{t}d', 6)} AS past_profitability_{t}d" for t in (1, *LONG)]
        + [f"{r(f'volatility_{t}d', 6)} AS volatility_{t}d" for t in LONG],
        "kpis",
    ),
)

# ------------------------------------------------------------------- E assets
ROI = """roi AS (
  SELECT s.split_id, rec_date, future_date, a.col_item, a.price AS price_current, b.price AS price_future,
         (b.price - a.price) / a.price AS roi, CAST(future_date - rec_date AS DOUBLE) AS days
  FROM splits s JOIN prices a ON a.col_timestamp = rec_date
  JOIN prices b ON b.col_timestamp = future_date AND b.col_item = a.col_item)"""
ANN, MONTH = "pow(1 + roi, 365 / days) - 1", "pow(1 + roi, 30 / days) - 1"
ENDS4 = f"{r('price_current', 4)} AS price_current, {r('price_future', 4)} AS price_future"
add(
    "asset_roi",
    f"{BASE}, {ROI}",
    f"SELECT split_id, rec_date, future_date, col_item, {ENDS4}, {r('roi', 6)} AS ROI FROM roi",
)
add(
    "asset_roi_scaled",
    f"{BASE}, {ROI}",
    f"SELECT split_id, col_item, {r(ANN, 6)} AS AnnROI, {r(MONTH, 6)} AS MonthROI FROM roi",
)
ALLVOL = f"{RETURNS1}, vol AS (SELECT col_item, stddev_samp(r1) * sqrt(252) AS v FROM returns GROUP BY 1)"
add("asset_volatility", f"{prices()}, {ALLVOL}", f"SELECT col_item, {r('v', 6)} AS Volatility FROM vol")
add("profitability", f"{BASE}, {ROI}", f"SELECT split_id, col_item, {r('roi', 6)} AS value FROM roi")
add(
    "profitability_fallback",
    f"{BASE}, {ROI}",
    f"""SELECT split_id, col_item, {r('roi', 6)} AS value FROM roi
UNION ALL SELECT split_id, p.col_item, {r('(m.top - p.price) / p.price', 6)}
FROM splits JOIN prices p ON col_timestamp = rec_date
JOIN (SELECT col_item, max(price) AS top FROM prices GROUP BY 1) m ON m.col_item = p.col_item
WHERE (split_id, p.col_item) NOT IN (SELECT split_id, col_item FROM roi)""",
)
WINDOWVOL = """inside AS (
  SELECT split_id, col_item, (price - lag(price) OVER w) / lag(price) OVER w AS r
  FROM prices JOIN splits ON col_timestamp BETWEEN rec_date AND future_date
  WINDOW w AS (PARTITION BY split_id, col_item ORDER BY col_timestamp)),
wvol AS (SELECT split_id, col_item, stddev_samp(r) * sqrt(252) AS value FROM inside GROUP BY 1, 2)"""
add("volatility_window", f"{BASE}, {WINDOWVOL}", f"SELECT split_id, col_item, {r('value', 6)} AS value FROM wvol")
STATS = f"""stats AS (
  SELECT roi.*, {ANN} AS ann, {MONTH} AS mon, v AS vol FROM roi JOIN vol USING (col_item))"""
add(
    "asset_stats",
    f"{BASE}, {ROI}, {ALLVOL}, {STATS}",
    f"""SELECT col_item, split_id, rec_date, future_date, {ENDS4}, {r('roi', 6)} AS ROI, {r('ann', 6)} AS AnnROI,
  {r('mon', 6)} AS MonthROI, {r('vol', 6)} AS Volatility FROM stats""",
)
MEASURES = {"ROI": "roi", "AnnROI": "ann", "MonthROI": "mon", "Volatility": "vol"}


def type6(x: str, i: int) -> str:
    s, n = f"list_sort(list({x}))", f"count({x})"
    j = f"CAST(greatest(1, least(({i} * ({n} + 1)) // 4, {n} - 1)) AS INTEGER)"
    delta = f"({i} * ({n} + 1) - 4 * {j})"
    return f"(({s})[{j}] * (4 - {delta}) + ({s})[{j} + 1] * {delta}) / 4.0"


add(
    "asset_summary",
    f"{BASE}, {ROI}, {ALLVOL}, {STATS}",
    "SELECT split_id, rec_date, future_date, "
    + ", ".join(
        f"""{r(f'avg({x})', 6)} AS "overall_mean_{m}", {r(type6(x, 1), 6)} AS "overall_q1_{m}",
  {r(type6(x, 2), 6)} AS "overall_median_{m}", {r(type6(x, 3), 6)} AS "overall_q3_{m}",
  {r(f'1.0 - count(*) FILTER ({x} > 0) / CAST(count(*) AS DOUBLE)', 6)} AS "overall_perc_non_profitable_{m}" """
        for m, x in MEASURES.items()
    )
    + f""", {r('pow(1 + avg(roi), 30 / any_value(days)) - 1', 6)} AS index_month_roi,
  {r('pow(1 + avg(roi), 365 / any_value(days)) - 1', 6)} AS index_annual_roi
FROM stats GROUP BY 1, 2, 3""",
)
add(
    "asset_index_roi",
    f"{BASE}, {ROI}",
    f"""SELECT split_id, {r('avg(roi)', 6)} AS mean_roi,
  {r('pow(1 + avg(roi), 30 / any_value(days)) - 1', 6)} AS index_month_roi,
  {r('pow(1 + avg(roi), 365 / any_value(days)) - 1', 6)} AS index_annual_roi FROM roi GROUP BY 1""",
)
CENSUS_USERS = {
    "split_census": "SELECT DISTINCT split_id, col_user FROM train",
    "split_census_all": "SELECT DISTINCT split_id, col_user FROM trades JOIN splits ON TRUE",
}
for _name, _users in CENSUS_USERS.items():
    add(
        _name,
        f"""{FULL}, {ROI},
u AS ({_users}),
tx AS (SELECT s.split_id, t.*, rec_date FROM trades t JOIN splits s ON col_timestamp < future_date
       JOIN u ON u.split_id = s.split_id AND u.col_user = t.col_user),
during AS (SELECT tx.* FROM tx JOIN full_test f ON f.split_id = tx.split_id AND f.col_item = tx.col_item
           WHERE col_timestamp >= rec_date)""",
        """SELECT split_id,
  (SELECT count(*) FROM roi x WHERE x.split_id = s.split_id) AS num_assets,
  (SELECT count(*) FROM u x WHERE x.split_id = s.split_id) AS num_users,
  (SELECT count(*) FROM full_test x WHERE x.split_id = s.split_id) AS num_assets_rec,
  (SELECT count(*) FROM train x WHERE x.split_id = s.split_id) AS train_ratings,
  (SELECT count(*) FROM train x WHERE x.split_id = s.split_id AND col_rating > 0) AS positive_train_ratings,
  (SELECT count(*) FROM test x WHERE x.split_id = s.split_id) AS test_ratings,
  (SELECT count(*) FROM test x WHERE x.split_id = s.split_id AND col_rating > 0) AS positive_test_ratings,
  (SELECT count(*) FROM tx x WHERE x.split_id = s.split_id AND col_timestamp < x.rec_date) AS train_transactions,
  (SELECT count(*) FROM tx x WHERE x.split_id = s.split_id AND col_timestamp < x.rec_date AND col_rating > 0)
    AS training_buys,
  (SELECT count(*) FROM during x WHERE x.split_id = s.split_id) AS test_transactions,
  (SELECT count(*) FROM during x WHERE x.split_id = s.split_id AND col_rating > 0) AS test_buys
FROM splits s""",
    )

# ---------------------------------------------------------------- F customers
SIGNED = "CASE WHEN col_rating > 0 THEN abs(units) ELSE -abs(units) END"
FOLD = "lambda a, x: CASE WHEN a + x < 1e-8 THEN 0.0::DOUBLE ELSE a + x END"
add(
    "holdings_replay",
    f"""{TRADES}, lists AS (
  SELECT *, list({SIGNED}) OVER (PARTITION BY col_user, col_item ORDER BY col_timestamp, seq
                                 ROWS UNBOUNDED PRECEDING) AS d FROM trades)""",
    f"""SELECT col_user, col_item, col_timestamp, l_orderkey, col_rating, units,
  list_reduce(list_prepend(0.0::DOUBLE, d), {FOLD}) AS holdings FROM lists""",
)
add(
    "holdings_at_split",
    f"{BASE}, {TRADES}",
    f"""SELECT split_id, col_user, col_item,
  list_reduce(list_prepend(0.0::DOUBLE, list({SIGNED} ORDER BY col_timestamp, seq)), {FOLD}) AS units
FROM trades JOIN splits ON col_timestamp < rec_date GROUP BY 1, 2, 3""",
)
WRITEOFF = f"""{LIMITS},
valued AS (
  SELECT s.split_id, l.col_item, rec_date,
    coalesce(p.price, CASE WHEN rec_date < min_date THEN price_min_date END) AS open_price,
    coalesce(f.price, CASE WHEN future_date < min_date THEN price_min_date
                           WHEN future_date > max_date THEN price_max_date END) AS close_price
  FROM splits s JOIN limits l ON TRUE
  LEFT JOIN prices p ON p.col_item = l.col_item AND p.col_timestamp = rec_date
  LEFT JOIN prices f ON f.col_item = l.col_item AND f.col_timestamp = future_date),
gone AS (SELECT split_id, col_item, rec_date AS w FROM valued WHERE open_price IS NULL),
last_gone AS (
  SELECT s.split_id, g.col_item, max(w) AS w FROM splits s JOIN gone g ON w < s.rec_date GROUP BY 1, 2),
opening AS (
  SELECT s.split_id, t.col_user, t.col_item,
    list_reduce(list_prepend(0.0::DOUBLE, list({SIGNED} ORDER BY col_timestamp, seq)), {FOLD}) AS units
  FROM trades t JOIN splits s ON col_timestamp < rec_date
  LEFT JOIN last_gone g ON g.split_id = s.split_id AND g.col_item = t.col_item
  WHERE w IS NULL OR col_timestamp >= w GROUP BY 1, 2, 3),
held AS (
  SELECT o.*, g.w IS NOT NULL AS written_off
  FROM opening o LEFT JOIN gone g ON g.split_id = o.split_id AND g.col_item = o.col_item)"""
add("holdings_writeoff", f"{BASE}, {TRADES}, {WRITEOFF}", "SELECT * FROM held")


def portfolio(flow: str) -> str:
    return f"""{WRITEOFF},
period AS (
  SELECT split_id, col_user, col_item, list({SIGNED} ORDER BY col_timestamp, seq) AS d,
    sum(CASE WHEN col_rating > 0 THEN abs({flow}) ELSE 0 END) AS bought,
    sum(CASE WHEN col_rating > 0 THEN 0 ELSE abs({flow}) END) AS sold
  FROM trades JOIN splits ON col_timestamp BETWEEN rec_date AND future_date GROUP BY 1, 2, 3),
joined AS (
  SELECT split_id, col_user, col_item, coalesce(units, 0) AS open_units,
    CASE WHEN d IS NULL THEN coalesce(units, 0)
         ELSE list_reduce(list_prepend(coalesce(units, 0), d), {FOLD}) END AS close_units,
    coalesce(bought, 0) AS bought, coalesce(sold, 0) AS sold, coalesce(written_off, FALSE) AS written_off
  FROM held FULL OUTER JOIN period USING (split_id, col_user, col_item)),
positions AS (
  SELECT split_id, col_user, open_units * coalesce(open_price, 0) AS open_value, bought, sold, close_units,
    close_units * coalesce(close_price, 0) AS close_value
  FROM joined JOIN valued USING (split_id, col_item) WHERE NOT written_off),
everyone AS (SELECT DISTINCT split_id, col_user FROM joined),
totals AS (
  SELECT split_id, col_user, coalesce(sum(open_value), 0) AS open_value, coalesce(sum(bought), 0) AS bought,
    coalesce(sum(sold), 0) AS sold, coalesce(sum(close_units), 0) AS close_units,
    coalesce(sum(close_value), 0) AS close_value
  FROM everyone LEFT JOIN positions USING (split_id, col_user) GROUP BY 1, 2),
returns AS (
  SELECT split_id, col_user, open_value + bought AS buy_price, close_value + sold AS sell_price,
    CAST(future_date - rec_date AS DOUBLE) AS days FROM totals JOIN splits USING (split_id)),
rated AS (
  SELECT *, sell_price / buy_price - 1 AS profitability, pow(sell_price / buy_price, 365 / days) - 1 AS ann_profit,
    pow(sell_price / buy_price, 30 / days) - 1 AS month_profit FROM returns WHERE buy_price > 0)"""


UNITS = f"{BASE}, {TRADES}, {portfolio('units')}"
MONEY = f"{BASE}, {TRADES}, {portfolio('value')}"
add("portfolio_open_value", UNITS, f"SELECT split_id, col_user, {r('open_value', 2)} AS open_value FROM totals")
add("portfolio_flows", MONEY, f"SELECT split_id, col_user, {r('bought', 2)} AS bought, {r('sold', 2)} AS sold FROM totals")
add(
    "portfolio_close_value",
    UNITS,
    f"""SELECT split_id, col_user, {r('close_units', 2)} AS close_units, {r('close_value', 2)} AS close_value
FROM totals""",
)
add(
    "customer_returns",
    UNITS,
    f"""SELECT split_id, col_user, {r('buy_price', 2)} AS buy_price, {r('sell_price', 2)} AS sell_price,
  {r('profitability', 6)} AS profitability, {r('ann_profit', 6)} AS ann_profit,
  {r('month_profit', 6)} AS month_profit FROM rated""",
)
SCALE = {"profitability": "1.0", "month_profit": "30 / any_value(days)", "ann_profit": "365 / any_value(days)"}
add(
    "customer_summary",
    f"""{UNITS}, overall AS (
  SELECT split_id, sum(sell_price) / sum(buy_price) AS total FROM returns GROUP BY 1)""",
    "SELECT split_id, "
    + ", ".join(
        f"""{r(f'avg({m})', 5)} AS {m}mean, {r(f'pow(any_value(total), {SCALE[m]}) - 1', 5)} AS {m}total_prof,
  {r(f'quantile_cont({m}, 0.25)', 5)} AS {m}q1, {r(f'quantile_cont({m}, 0.5)', 5)} AS {m}median,
  {r(f'quantile_cont({m}, 0.75)', 5)} AS {m}q3, {r(f'min({m})', 5)} AS {m}min, {r(f'max({m})', 5)} AS {m}max,
  {r(f'count(*) FILTER ({m} > 0) / CAST(count(*) AS DOUBLE)', 5)} AS {m}perc_profit"""
        for m in SCALE
    )
    + "\nFROM rated JOIN overall USING (split_id) GROUP BY 1",
)
add(
    "customer_stats",
    MONEY,
    f"""SELECT split_id, count(*) AS customers, {r('sum(buy_price)', 0)} AS buy_price,
  {r('sum(sell_price)', 0)} AS sell_price, {r('avg(profitability)', 5)} AS mean_profitability
FROM rated GROUP BY 1""",
)

# ---------------------------------------------------------- G recommendations
LEAD = f"lead(price, 126) OVER ({SERIES})"
add(
    "forward_target",
    DAILY,
    table([f"{r(LEAD, 4)} AS final_price", f"{r(f'({LEAD} - price) / price', 6)} AS target"]),
)
COMPLETE, KPI_NAMES = kpis(SHORT, FULL)
LABELLED = f"""{COMPLETE},
complete AS (SELECT * FROM smooth WHERE {' AND '.join(f'{n} IS NOT NULL' for n in KPI_NAMES)}),
labelled AS (SELECT *, ({LEAD} - price) / price AS target FROM complete)"""
add(
    "training_set",
    LABELLED,
    f"""SELECT split_id, col_item, col_timestamp, {', '.join(f'{r(n, 4)} AS {n}' for n in features('full_short'))},
  {r('target', 4)} AS target
FROM labelled JOIN splits ON col_timestamp < rec_date - 180 JOIN priced USING (split_id, col_item)
WHERE price > 0 AND target IS NOT NULL""",
)
add(
    "rf_scored_assets",
    LABELLED,
    """SELECT split_id, col_item, TRUE AS finite, TRUE AS within_targets FROM complete
JOIN splits ON col_timestamp = rec_date JOIN priced USING (split_id, col_item)
JOIN (SELECT DISTINCT split_id FROM labelled JOIN splits ON col_timestamp < rec_date - 180
      JOIN priced USING (split_id, col_item) WHERE target IS NOT NULL) fitted USING (split_id)""",
)
RECS = f"""scores AS (
  SELECT split_id, col_item, score
  FROM (SELECT *, {ret(21)} AS score FROM prices) JOIN splits ON col_timestamp = rec_date
  JOIN priced USING (split_id, col_item) WHERE score IS NOT NULL),
eligible AS (
  SELECT DISTINCT split_id, col_user FROM test
  WHERE (split_id, col_user) IN (SELECT split_id, col_user FROM train)),
recs AS (
  SELECT e.split_id, e.col_user, s.col_item, s.score,
    CAST(row_number() OVER (PARTITION BY e.split_id, e.col_user ORDER BY s.score DESC, s.col_item) AS INTEGER) AS rank
  FROM eligible e JOIN scores s ON s.split_id = e.split_id
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.split_id = e.split_id AND t.col_user = e.col_user
                    AND t.col_item = s.col_item))"""
LISTS = f"{FULL}, {RECS}"
add("recommend_cross", LISTS, f"SELECT split_id, col_user, col_item, {r('score', 6)} AS score FROM recs")
add("recommend_ranked", LISTS, f"SELECT split_id, col_user, col_item, {r('score', 6)} AS score, rank FROM recs")

# --------------------------------------------------------------- H evaluation
add("topk", LISTS, "SELECT split_id, col_user, col_item, rank FROM recs WHERE rank <= 5")
KS = ", ".join(f"({c})" for c in CUTOFFS)
VALUES = {
    "profitability": "SELECT split_id, col_item, roi AS value FROM roi",
    "annualized_prof": f"SELECT split_id, col_item, {ANN} AS value FROM roi",
    "monthly_prof": f"SELECT split_id, col_item, {MONTH} AS value FROM roi",
    "volatility": "SELECT split_id, col_item, value FROM wvol",
}


def kpi(metric: str) -> str:
    return f"""SELECT split_id, '{metric}' AS metric, CAST(k AS INTEGER) AS cutoff, col_user,
    avg(CASE WHEN v.col_item IS NULL THEN 0.0 ELSE v.value END) AS value
  FROM recs LEFT JOIN ({VALUES[metric]}) v USING (split_id, col_item)
  JOIN (VALUES {KS}) c(k) ON rank <= k GROUP BY 1, 2, 3, 4"""


EVAL = f"{LISTS}, {ROI}, {WINDOWVOL}, {POSITIVES}"


def ndcg(positives: str) -> str:
    return f"""SELECT e.split_id, 'ndcg' AS metric, CAST(k AS INTEGER) AS cutoff, e.col_user,
    coalesce((SELECT sum(1 / ln(rank + 1)) FROM recs x JOIN {positives} p USING (split_id, col_user, col_item)
              WHERE x.split_id = e.split_id AND x.col_user = e.col_user AND rank <= k)
      / (SELECT sum(1 / ln(j + 1)) FROM range(1, 1001) t(j)
         WHERE j <= k AND j <= (SELECT count(*) FROM {positives} p
                                WHERE p.split_id = e.split_id AND p.col_user = e.col_user)), 0.0) AS value
  FROM eligible e JOIN (VALUES {KS}) c(k) ON TRUE"""


def long(body: str) -> str:
    return f"SELECT split_id, metric, cutoff, col_user, {r('value', 6)} AS value FROM ({body})"


add("kpi_at_k", EVAL, long(kpi("profitability")))
add("kpi_annual_at_k", EVAL, long(kpi("annualized_prof")))
add("kpi_monthly_at_k", EVAL, long(kpi("monthly_prof")))
add("volatility_at_k", EVAL, long(kpi("volatility")))
MEAN = f"""SELECT split_id, metric, cutoff,
  {r('sum(value) / (SELECT count(*) FROM eligible e WHERE e.split_id = p.split_id)', 6)} AS value"""
add("kpi_at_k_mean", EVAL, f"{MEAN} FROM ({kpi('profitability')}) p GROUP BY 1, 2, 3")
add(
    "kpi_at_k_fixed_denominator",
    EVAL,
    f"""SELECT split_id, 'profitability_fixed' AS metric, CAST(k AS INTEGER) AS cutoff, col_user,
  {r('''CASE WHEN k < 0 THEN sum(coalesce(v.roi, 0)) / count(*)
     ELSE sum(CASE WHEN rank <= k THEN coalesce(v.roi, 0) ELSE 0 END) / k END''', 6)} AS value
FROM recs LEFT JOIN roi v USING (split_id, col_item) JOIN (VALUES (-1), {KS}) c(k) ON TRUE GROUP BY 1, 2, 3, 4, k""",
)
add("ndcg_at_k", EVAL, long(ndcg("positives")))
add(
    "ndcg_history",
    f"""{EVAL}, fresh AS (
  SELECT * FROM positives p WHERE NOT EXISTS (
    SELECT 1 FROM trades t WHERE t.col_timestamp < DATE '{LATER}' AND t.col_user = p.col_user
    AND t.col_item = p.col_item))""",
    long(ndcg("fresh")),
)
METRICS = [*VALUES, "ndcg"]
ALL = "\nUNION ALL ".join([*[kpi(m) for m in VALUES], ndcg("positives")])
add("recommendation_run", f"{EVAL}, every AS ({ALL})", f"{MEAN} FROM every p GROUP BY 1, 2, 3")
add(
    "metrics_wide",
    f"{EVAL}, every AS ({ALL})",
    "SELECT split_id, col_user, "
    + ", ".join(
        f"""{r(f"max(value) FILTER (metric = '{m}' AND cutoff = {c})", 6)} AS "{m}@{c}" """
        for m in METRICS
        for c in CUTOFFS
    )
    + f"\nFROM every GROUP BY 1, 2 HAVING count(*) = {len(METRICS) * len(CUTOFFS)}",
)

# --------------------------------------------------------- I graph and sampling
add(
    "popularity",
    TRADES,
    f"""SELECT col_item, count(*) AS n, {r('count(*) / CAST((SELECT count(*) FROM trades) AS DOUBLE)', 6)} AS share
FROM trades GROUP BY 1""",
)
MULT = ((73856093, 19349663, 83492791, 15485863), (49979687, 32452843, 67867967, 86028121))
FAR = ((15485867, 22801763, 32452867, 41161739), (53982895, 61169369, 71838043, 79190629))
SPACE = PRIME * PRIME


def draw(name: str, source: str, columns: str, seed: int, *keys: str) -> str:
    """CTEs ending in ``name`` with an extra column ``h`` in [0, SPACE); keys are not negative."""

    def mixed(word: int) -> str:
        terms = [
            f"(({k})::BIGINT % {PRIME}) * {a} + (({k})::BIGINT // {PRIME} % {PRIME}) * {b}"
            for k, a, b in zip(keys, MULT[word], FAR[word], strict=False)
        ]
        return f"({' + '.join([str(seed), *terms])}) % {PRIME}"

    def fifth(x: str) -> str:
        return f"((({x} * {x}) % {PRIME}) * (({x} * {x}) % {PRIME}) % {PRIME}) * {x} % {PRIME}"

    return f"""{name}_0 AS (SELECT {columns}, {mixed(0)} AS x0, {mixed(1)} AS x1 FROM {source}),
{name}_1 AS (SELECT * EXCLUDE (x0, x1), (({fifth('x0')}) * 48271 + 1) % {PRIME} AS y0,
  (({fifth('x1')}) * 48271 + 1) % {PRIME} AS y1 FROM {name}_0),
{name} AS (SELECT * EXCLUDE (y0, y1), ({fifth('y0')}) * {PRIME} + {fifth('y1')} AS h FROM {name}_1)"""


def uniform() -> str:
    return f"((h::DOUBLE + 0.5) / {float(SPACE)!r}::DOUBLE)"


def below(n: str) -> str:
    """floor(h * n / SPACE), exactly."""
    return f"CAST(h::HUGEINT * ({n})::HUGEINT // {SPACE}::HUGEINT AS BIGINT)"


add(
    "weighted_sample",
    f"""{INDEX}, weights AS (SELECT item_idx, count(*) AS n FROM edges GROUP BY 1),
line AS (
  SELECT item_idx, n,
    coalesce(sum(n) OVER (ORDER BY substr(md5(CAST(item_idx AS VARCHAR)), 1, 3), item_idx
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM weights),
asked AS (SELECT user_idx, CAST(d AS INTEGER) AS draw FROM users JOIN range(0, 4) t(d) ON TRUE),
{draw('drawn', 'asked', '*', SEED, 'user_idx', 'draw')}""",
    f"""SELECT user_idx, draw, item_idx FROM (
  SELECT *, {below('SELECT sum(n) FROM weights')} AS p FROM drawn) q
JOIN line ON start <= p AND p < start + n""",
)


add(
    "weighted_choice_excluding",
    f"""{INDEX}, counted AS (SELECT item_idx, count(*) AS n FROM edges GROUP BY 1),
weights AS (SELECT * FROM counted WHERE item_idx <> (SELECT item_idx FROM counted ORDER BY n DESC, item_idx LIMIT 1)),
line AS (
  SELECT item_idx, n,
    coalesce(sum(n) OVER (ORDER BY substr(md5(CAST(item_idx AS VARCHAR)), 1, 3), item_idx
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM weights),
asked AS (SELECT user_idx, CAST(d AS INTEGER) AS draw FROM users JOIN range(0, 4) t(d) ON TRUE),
{draw('drawn', 'asked', '*', SEED, 'user_idx', 'draw')}""",
    f"""SELECT user_idx, draw, item_idx FROM (
  SELECT *, {below('SELECT sum(n) FROM weights')} AS p FROM drawn) q
JOIN line ON start <= p AND p < start + n""",
)


def distinct_draws(count: int) -> str:
    """Each draw lays the keys a customer has not drawn yet end to end and picks one."""
    steps = ["taken AS (SELECT user_idx, 0 AS draw, item_idx FROM edges WHERE FALSE)"]
    before = "taken"
    for j in range(count):
        steps.append(draw(f"h{j}", "users", "user_idx", SEED, "user_idx", str(j)))
        steps.append(
            f"""left{j} AS (
  SELECT user_idx, item_idx, n, sum(n) OVER (PARTITION BY user_idx ORDER BY pos) - n AS start,
         sum(n) OVER (PARTITION BY user_idx) AS total
  FROM users u JOIN ordered o ON TRUE
  WHERE NOT EXISTS (SELECT 1 FROM {before} t WHERE t.user_idx = u.user_idx AND t.item_idx = o.item_idx)),
taken{j} AS (
  SELECT * FROM {before}
  UNION ALL SELECT user_idx, {j}, item_idx FROM left{j} JOIN h{j} USING (user_idx)
  WHERE start <= {below('total')} AND {below('total')} < start + n)"""
        )
        before = f"taken{j}"
    return f"""{INDEX}, weights AS (SELECT item_idx, count(*) AS n FROM edges GROUP BY 1),
ordered AS (
  SELECT item_idx, n, row_number() OVER (ORDER BY substr(md5(CAST(item_idx AS VARCHAR)), 1, 3), item_idx) AS pos
  FROM weights),
{', '.join(steps)}"""


add("weighted_sample_distinct", distinct_draws(3), "SELECT user_idx, draw, item_idx FROM taken2")


def negatives(n: int) -> str:
    """Floyd's sampling, unrolled, and the unseen assets of a customer as an explicit sorted list."""
    steps = []
    source, columns = "degrees", "*"
    for k in range(n):
        steps.append(draw(f"f{k}", source, columns, SEED, "user_idx", "item_idx", str(k)))
        earlier = ", ".join(f"t{i}" for i in range(k))
        taken = f"list_contains([{earlier}], pick)" if k else "FALSE"
        steps.append(
            f"""g{k} AS (
  SELECT * EXCLUDE (h, pick, top), CASE WHEN {k} >= size THEN NULL WHEN {taken} THEN top ELSE pick END AS t{k}
  FROM (SELECT *, m - size + {k} AS top,
          {below(f'greatest(m - size + {k} + 1, 1)')} AS pick FROM f{k}))"""
        )
        source = f"g{k}"
    return f"""{INDEX},
unseen AS (
  SELECT user_idx, list(item_idx ORDER BY item_idx) AS free FROM (
    SELECT user_idx, item_idx FROM users JOIN items ON TRUE
    EXCEPT SELECT user_idx, item_idx FROM edges) GROUP BY 1),
degrees AS (
  SELECT user_idx, item_idx, col_rating, free, coalesce(len(free), 0) AS m, least({n}, coalesce(len(free), 0)) AS size
  FROM edges LEFT JOIN unseen USING (user_idx)),
{', '.join(steps)}"""


add(
    "neg_multi",
    negatives(NEGATIVES),
    f"""SELECT user_idx, item_idx AS pos_idx, {', '.join(f'free[t{k} + 1] AS neg_{k}' for k in range(NEGATIVES))}
FROM g{NEGATIVES - 1} WHERE size > 0""",
)
add(
    "neg_pairwise",
    negatives(1),
    "SELECT user_idx, item_idx AS pos_idx, free[t0 + 1] AS neg_idx FROM g0 WHERE size > 0",
)
add(
    "neg_pointwise",
    negatives(NEGATIVES),
    "SELECT user_idx, item_idx, col_rating AS label FROM edges\nUNION ALL "
    + "\nUNION ALL ".join(
        f"SELECT user_idx, free[t{k} + 1], 0.0::DOUBLE FROM g{NEGATIVES - 1} WHERE t{k} IS NOT NULL"
        for k in range(NEGATIVES)
    ),
)
NODES = f"{INDEX}, size AS (SELECT count(*) AS nu FROM users)"


def both(source: str, there: str, back: str) -> str:
    return f"""SELECT user_idx AS src, item_idx + (SELECT nu FROM size) AS dst, {r(there, 6)} AS weight FROM {source}
UNION ALL SELECT item_idx + (SELECT nu FROM size), user_idx, {r(back, 6)} FROM {source}"""


DEGREES = """degreed AS (
  SELECT *, count(*) OVER (PARTITION BY user_idx) AS du, count(*) OVER (PARTITION BY item_idx) AS di FROM edges)"""
add("graph_adjacency", NODES, both("edges", "1.0::DOUBLE", "1.0::DOUBLE"))
add("graph_mean_adj", f"{NODES}, {DEGREES}", both("degreed", "1.0 / du", "1.0 / di"))
add(
    "graph_norm_adj",
    f"{NODES}, {DEGREES}",
    both("degreed", "1.0 / (du + 1)", "1.0 / (di + 1)")
    + f"""
UNION ALL SELECT DISTINCT user_idx, user_idx, {r('1.0 / (du + 1)', 6)} FROM degreed
UNION ALL SELECT DISTINCT item_idx + nu, item_idx + nu, {r('1.0 / (di + 1)', 6)} FROM degreed, size""",
)
add(
    "graph_constraint",
    f"{NODES}, {DEGREES}",
    f"""SELECT DISTINCT 'user' AS side, user_idx AS idx, {r('sqrt(du + 1) / du', 6)} AS beta FROM degreed
UNION ALL SELECT DISTINCT 'item', item_idx, {r('1 / sqrt(di + 1)', 6)} FROM degreed""",
)


def symmetric(source: str) -> str:
    return f"""counted AS (SELECT user_idx, item_idx, count(*) AS c FROM {source} GROUP BY 1, 2),
weighted AS (
  SELECT *, c / (sqrt(sum(c) OVER (PARTITION BY user_idx)) * sqrt(sum(c) OVER (PARTITION BY item_idx))) AS w
  FROM counted)"""


RAW_EDGES = "raw_edges AS (SELECT * FROM trades JOIN users USING (col_user) JOIN items USING (col_item))"
add("graph_sym_norm", f"{NODES}, {RAW_EDGES}, {symmetric('raw_edges')}", both("weighted", "w", "w"))
add(
    "graph_edge_dropout",
    f"""{NODES}, {draw('ed', 'edges', '*', SEED, 'user_idx', 'item_idx')},
kept AS (
  SELECT * FROM ed
  QUALIFY row_number() OVER (ORDER BY h, user_idx, item_idx)
          <= floor((SELECT count(*) FROM edges) * {1.0 - DROP!r}::DOUBLE)),
{symmetric('kept')}""",
    both("weighted", "w", "w"),
)


def kept_nodes(name: str, source: str, key: str, seed: int) -> str:
    return f"""{draw(f'{name}_d', source, key, seed, key)},
{name} AS (
  SELECT {key} FROM {name}_d
  QUALIFY row_number() OVER (ORDER BY h, {key})
          <= (SELECT count(*) FROM {source}) - floor((SELECT count(*) FROM {source}) * {DROP!r}::DOUBLE))"""


add(
    "graph_node_dropout",
    f"""{NODES}, {kept_nodes('ku', 'users', 'user_idx', SEED)}, {kept_nodes('ki', 'items', 'item_idx', SEED + 1)},
kept AS (SELECT * FROM edges JOIN ku USING (user_idx) JOIN ki USING (item_idx)),
{symmetric('kept')}""",
    both("weighted", "w", "w"),
)
add(
    "user_vectors",
    f"{NODES}, {RAW_EDGES}",
    "SELECT user_idx, item_idx, sum(col_rating) AS value FROM raw_edges GROUP BY 1, 2",
)
add(
    "random_features",
    f"""{NODES}, cells AS (SELECT user_idx, CAST(d AS INTEGER) AS dim FROM users JOIN range(0, 4) t(d) ON TRUE),
{draw('ra', 'cells', '*', SEED, 'user_idx', 'dim')},
rb_in AS (SELECT user_idx, dim, {uniform()} AS u1 FROM ra),
{draw('rb', 'rb_in', '*', SEED + 1, 'user_idx', 'dim')}""",
    f"SELECT user_idx, dim, {r(f'sqrt(-2 * ln(u1)) * cos(2 * pi() * {uniform()})', 6)} AS value FROM rb",
)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
