"""Column names shared by every table."""

# Column names of the public tables.
USER = "col_user"
ITEM = "col_item"
RATING = "col_rating"
TS = "col_timestamp"
PRICE = "price"
SEQ = "seq"
BLOCK = "seq_block"
UNITS = "units"
VALUE = "value"
SPLIT = "split_id"
REC = "rec_date"
FUT = "future_date"
SCORE = "score"
RANK = "rank"
CUTOFF = "cutoff"

TRADING_DAYS = 252
MONTH_DAYS = 30
YEAR_DAYS = 365
