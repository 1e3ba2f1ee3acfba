"""Check SQL of the order-book views."""

from __future__ import annotations

from tapeflow.plans.views import SQL_VIEWS as V

V["l2k"] = (
    """SELECT product_id, window_ms, seq, CASE side WHEN 'bid' THEN 'bid' ELSE 'ask' END AS side, price_level AS price,
         new_quantity AS size, buy_volume, sell_volume,
         dense_rank() OVER (PARTITION BY product_id ORDER BY window_ms) - 1 AS k FROM l2_updates""",
    ("l2_updates",),
)
V["l2win"] = (
    """SELECT product_id, window_ms, k, sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume,
         (count(*) % 7 - 3) / 4000e0 AS price_change FROM l2k GROUP BY ALL""",
    ("l2k",),
)
V["l2ver"] = (
    """SELECT *, lead(k) OVER (PARTITION BY product_id, side, price ORDER BY k) AS k_next
       FROM (SELECT product_id, side, price, k, arg_max(size, seq) AS size FROM l2k GROUP BY ALL)""",
    ("l2k",),
)
V["book"] = (
    """SELECT w.product_id, w.window_ms, w.k, v.side, v.price, v.size, row_number() OVER (PARTITION BY w.product_id, w.k, v.side
         ORDER BY CASE v.side WHEN 'bid' THEN -v.price ELSE v.price END) AS rnk
       FROM l2win w JOIN l2ver v ON v.product_id = w.product_id AND v.k <= w.k AND w.k < coalesce(v.k_next, 1000000000) AND v.size > 0""",
    ("l2win", "l2ver"),
)
_tops = ", ".join(
    f"coalesce(sum(size) FILTER (side = '{s}' AND rnk <= {n}), 0e0) AS {s}_depth_top{n}" for s in ("bid", "ask") for n in (5, 10, 20)
)
V["booksum"] = (
    f"""SELECT product_id, window_ms, k, coalesce(max(price) FILTER (side = 'bid' AND rnk = 1), 0e0) AS bb,
         coalesce(max(price) FILTER (side = 'ask' AND rnk = 1), 0e0) AS ba,
         coalesce(max(size) FILTER (side = 'bid' AND rnk = 1), 0e0) AS best_bid_size,
         coalesce(max(size) FILTER (side = 'ask' AND rnk = 1), 0e0) AS best_ask_size, {_tops},
         coalesce(sum(size / rnk) FILTER (side = 'bid' AND rnk <= 10), 0e0) AS wbid,
         coalesce(sum(size / rnk) FILTER (side = 'ask' AND rnk <= 10), 0e0) AS wask,
         coalesce(CASE WHEN count(*) FILTER (side = 'bid') > 1 THEN regr_slope(size, rnk) FILTER (side = 'bid' AND rnk <= 5) END, 0e0) AS depth_slope_bid,
         coalesce(CASE WHEN count(*) FILTER (side = 'ask') > 1 THEN regr_slope(size, rnk) FILTER (side = 'ask' AND rnk <= 5) END, 0e0) AS depth_slope_ask
       FROM book GROUP BY ALL""",
    ("book",),
)
V["bookmid"] = (
    """SELECT *, CASE WHEN bb > 0 AND ba > 0 THEN (bb + ba) / 2e0 ELSE 0e0 END AS mid_price,
         CASE WHEN wbid + wask > 0 THEN (wbid - wask) / (wbid + wask) ELSE 0e0 END AS depth_imbalance_top10,
         CASE WHEN best_bid_size + best_ask_size > 0 THEN (best_bid_size - best_ask_size) / (best_bid_size + best_ask_size) ELSE 0e0 END AS top_of_book_imbalance,
         CASE WHEN best_bid_size + best_ask_size > 0 THEN (ba * best_bid_size + bb * best_ask_size) / (best_bid_size + best_ask_size) ELSE 0e0 END AS microprice
       FROM booksum""",
    ("booksum",),
)
_near = ", ".join(
    f"sum(CASE WHEN CASE b.side WHEN 'bid' THEN m.mid_price - b.price ELSE b.price - m.mid_price END <= m.mid_price * {bp}e0 / 10000e0 THEN b.size ELSE 0e0 END) AS c{bp}"
    for bp in (1, 5, 10)
)
V["booknear"] = (
    f"SELECT product_id, k, {_near} FROM bookmid m JOIN book b USING (product_id, k) WHERE m.mid_price > 0 GROUP BY ALL",
    ("bookmid", "book"),
)
V["l2chg"] = (
    """SELECT product_id, k, sum(greatest(size - old, 0e0)) FILTER (side = 'bid') AS ba_, sum(greatest(old - size, 0e0)) FILTER (side = 'bid') AS br_,
         sum(greatest(size - old, 0e0)) FILTER (side = 'ask') AS aa_, sum(greatest(old - size, 0e0)) FILTER (side = 'ask') AS ar_
       FROM (SELECT *, coalesce(lag(size) OVER (PARTITION BY product_id, side, price ORDER BY seq), 0e0) AS old FROM l2k) GROUP BY ALL""",
    ("l2k",),
)
V["bookin"] = (
    """SELECT m.*, w.buy_volume AS buy, w.sell_volume AS sell, w.price_change AS pc,
         CASE WHEN mid_price > 0 THEN ba - bb ELSE 0e0 END AS spread,
         CASE WHEN mid_price > 0 THEN (ba - bb) / mid_price ELSE 0e0 END AS relative_spread,
         CASE WHEN mid_price > 0 THEN (microprice - mid_price) / mid_price ELSE 0e0 END AS microprice_shift,
         coalesce(c1, 0e0) AS cumul_depth_1bp, coalesce(c5, 0e0) AS cumul_depth_5bp, coalesce(c10, 0e0) AS cumul_depth_10bp,
         coalesce(ba_, 0e0) AS bid_added, coalesce(br_, 0e0) AS bid_removed, coalesce(aa_, 0e0) AS ask_added, coalesce(ar_, 0e0) AS ask_removed,
         coalesce(lag(bid_depth_top10) OVER (PARTITION BY m.product_id ORDER BY m.k), bid_depth_top10) AS sb,
         coalesce(lag(ask_depth_top10) OVER (PARTITION BY m.product_id ORDER BY m.k), ask_depth_top10) AS sa
       FROM bookmid m JOIN l2win w USING (product_id, k) LEFT JOIN booknear USING (product_id, k) LEFT JOIN l2chg USING (product_id, k)""",
    ("bookmid", "booknear", "l2chg", "l2win"),
)


def _r(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN ({num}) / {den} ELSE 0e0 END"


V["bookdyn"] = (
    f"""SELECT * EXCLUDE (window_ms), window_ms, {_r('buy', 'sa')} AS eat_a, {_r('sell', 'sb')} AS eat_b, greatest(0e0, bid_removed - sell) AS cancelled_bid_vol,
          greatest(0e0, ask_removed - buy) AS cancelled_ask_vol FROM bookin""",
    ("bookin",),
)
_c = {
    "ask_consumption_rate": "least(eat_a, 1e0)",
    "bid_consumption_rate": "least(eat_b, 1e0)",
    "net_consumption": "least(eat_a, 1e0) - least(eat_b, 1e0)",
    "price_move_per_unit_flow": "CASE WHEN buy <> sell THEN least(greatest(pc / (buy - sell), -1000e0), 1000e0) ELSE 0e0 END",
    "seller_absorption_estimate": "CASE WHEN buy - sell > 0 AND eat_a > 0.3 AND abs(pc) < 0.0005e0 THEN least((buy - sell) / (buy + sell + 1e-9), 1e0) ELSE 0e0 END",
    "buyer_absorption_estimate": "CASE WHEN buy - sell < 0 AND eat_b > 0.3 AND abs(pc) < 0.0005e0 THEN least((sell - buy) / (buy + sell + 1e-9), 1e0) ELSE 0e0 END",
    "flow_to_price_divergence": f"CASE WHEN abs({_r('buy - sell', '(buy + sell)')}) > 0.3 AND abs(pc) < 0.0005e0 THEN abs((buy - sell) / (buy + sell)) ELSE 0e0 END",
    "refill_rate_ask": f"least(greatest({_r('ask_added - buy', 'sa')}, 0e0), 5e0)",
    "refill_rate_bid": f"least(greatest({_r('bid_added - sell', 'sb')}, 0e0), 5e0)",
    "cancel_rate_ask": f"least({_r('cancelled_ask_vol', 'sa')}, 5e0)",
    "cancel_rate_bid": f"least({_r('cancelled_bid_vol', 'sb')}, 5e0)",
    "bid_cancel_ratio": _r("cancelled_bid_vol", "bid_removed"),
    "ask_cancel_ratio": _r("cancelled_ask_vol", "ask_removed"),
    "phantom_bid_vol": "least(bid_added, cancelled_bid_vol)",
    "cancel_asymmetry": _r("cancelled_bid_vol - cancelled_ask_vol", "(cancelled_bid_vol + cancelled_ask_vol)"),
}
V["bookcols"] = (f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in _c.items())} FROM bookdyn", ("bookdyn",))
V["book_metrics"] = (
    """SELECT *, least(greatest(0.5e0 * (seller_absorption_estimate + buyer_absorption_estimate) + 0.3e0 * (1e0 - least(abs(net_consumption), 1e0))
         + 0.2e0 * (1e0 - least(abs(pc) / (0.0005e0 * 10 + 1e-9), 1e0)), 0e0), 1e0) AS absorption_score FROM bookcols""",
    ("bookcols",),
)
