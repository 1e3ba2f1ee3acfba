"""Order-book queries."""

from __future__ import annotations

import tapeflow.plans.sql_book  # noqa: F401  (registers the SQL views)
from tapeflow.functions.columns import rounded
from tapeflow.functions.names import BOOK_DEPTH, BOOK_DYNAMICS, BOOK_SPREAD
from tapeflow.operators import book as B
from tapeflow.plans.registry import query, r6
from tapeflow.plans.views import Inputs

KEY = ["product_id", "window_ms"]


@query(
    "book_state_at_close",
    f"SELECT product_id, window_ms, side, {r6('price', 'size')}, CAST(rnk AS INT) AS rank FROM book",
    ("book",),
)
def book_state_at_close(x: Inputs):
    updates = x.book_updates()
    levels = B.book_at_close(B.with_epoch(updates), x.book_windows(updates))
    return rounded(levels.drop("k"))


@query(
    "book_change_flow",
    f"""SELECT product_id, window_ms, {r6('bid_added', 'bid_removed', 'ask_added', 'ask_removed')} FROM
        (SELECT product_id, k, coalesce(ba_, 0e0) AS bid_added, coalesce(br_, 0e0) AS bid_removed,
          coalesce(aa_, 0e0) AS ask_added, coalesce(ar_, 0e0) AS ask_removed FROM l2chg) JOIN l2win USING (product_id, k)""",
    ("l2chg", "l2win"),
)
def book_change_flow(x: Inputs):
    return rounded(B.change_flow(B.with_epoch(x.book_updates())))


GROUPS = {
    "book_top": ["best_bid_size", "best_ask_size", "mid_price", "spread", "relative_spread"],
    "book_imbalance": ["top_of_book_imbalance", "microprice", "microprice_shift"],
    "book_depth_topn": [c for c in BOOK_DEPTH if "_top" in c and "depth_imb" not in c],
    "book_wbi": ["depth_imbalance_top10"],
    "book_depth_slope": ["depth_slope_bid", "depth_slope_ask"],
    "book_cumul_bps": ["cumul_depth_1bp", "cumul_depth_5bp", "cumul_depth_10bp"],
    "book_consumption": ["ask_consumption_rate", "bid_consumption_rate", "net_consumption"],
    "book_price_per_flow": ["price_move_per_unit_flow"],
    "book_absorption": ["seller_absorption_estimate", "buyer_absorption_estimate", "absorption_score"],
    "book_flow_divergence": ["flow_to_price_divergence"],
    "book_refill_cancel": ["refill_rate_ask", "refill_rate_bid", "cancel_rate_ask", "cancel_rate_bid"],
    "book_cancel_split": [c for c in BOOK_DYNAMICS if c.endswith(("_vol", "cancel_ratio", "asymmetry"))],
}


def _group(name: str, cols: list[str]) -> None:
    @query(name, f"SELECT product_id, window_ms, {r6(*cols)} FROM l2win LEFT JOIN book_metrics USING (product_id, window_ms)", ("l2win", "book_metrics"))
    def run(x: Inputs):
        updates = x.book_updates()
        return rounded(B.book_metrics(updates, x.book_windows(updates)).select(*KEY, *cols))


for _name, _cols in GROUPS.items():
    _group(_name, _cols)

ALL_BOOK = BOOK_SPREAD + BOOK_DEPTH + BOOK_DYNAMICS
_group("book_metrics", ALL_BOOK)
