"""DuckDB oracle text, second part: reserves, categories, lineage, token
supply, parameters, the account cluster and the scenario model.  Merged into
:mod:`carrylens.plans.oracle` on import."""

from __future__ import annotations

from .oracle import SH, U, VAULT, A, Z

# columns of the parameter row
PARAMS = ("debt_reserve_ltv debt_reserve_factor ir_uopt ir_base ir_slope1 ir_slope2 debt_borrow_rate debt_supply_rate debt_utilisation "
          "best_category_id best_category_ltv best_category_lt best_category_bonus staking_ratio exchange_rate").split()
TGT = "'0xa" + "0" * 39 + "'"
D = "::DOUBLE"


def roe(L: str, r: str) -> str:
    return f"({L} * 0.04{D} - ({L} - 1.0{D}) * {r})"


def eq(uopt: str = "uopt", s1: str = "slope1") -> str:
    """Equilibrium columns; expects ``hurdle`` and ``L`` in scope."""
    r = f"(0.04{D} - (hurdle - 0.04{D}) / (L - 1.0{D}))"
    u = (f"(CASE WHEN {r} <= 0.0{D} + {s1} THEN {uopt} * ({r} - 0.0{D}) / {s1} "
         f"ELSE {uopt} + (1.0{D} - {uopt}) * ({r} - 0.0{D} - {s1}) / 0.12{D} END)")
    br = f"(CASE WHEN {r} <= 0.0{D} + {s1} THEN 'below kink' ELSE 'above kink' END)"
    rev = f"(1e9 * {u} * {r} * 0.25{D})"
    apy = f"({r} * {u} * (1.0{D} - 0.25{D}))"
    return f"{r} AS r_star, {u} AS u_star, {br} AS branch, {rev} AS revenue, {apy} AS supply_apy"


EQ_SQ = eq(f"0.90{D}", f"0.04{D}")
EQ_ALT = eq(f"0.90{D}", f"0.035{D}")
EQCOLS = "round(r_star, 8) AS r_star, round(u_star, 8) AS u_star, branch, round(revenue, 4) AS revenue, round(supply_apy, 8) AS supply_apy"

def _setup_rows() -> list[str]:
    """The setup table's rows: each source of one row, and its parameters as text."""
    num, whole = "printf('%.8f', {})".format, "CAST(CAST(round({}) AS BIGINT) AS VARCHAR)".format
    debt = [("debt_symbol", "symbol"), ("debt_borrow_rate", num("borrow_rate")), ("debt_supply_rate", num("supply_rate")),
            ("debt_reserve_factor", num("r.reserve_factor")), ("ir_base", num("base_rate")), ("ir_uopt", num("r.uopt")), ("ir_slope1", num("slope1")),
            ("ir_slope2", num("slope2")), ("debt_supply_cap", "CAST(cents * 1000 AS VARCHAR)"), ("debt_borrow_cap", "CAST(cents * 900 AS VARCHAR)"),
            ("debt_total_supplied", whole("total_supplied")), ("debt_total_borrowed", whole("total_variable_debt")),
            ("debt_utilisation", num("round(total_variable_debt / total_supplied, 8)"))]
    collateral = [("collateral_symbol", "symbol"), ("collateral_reserve_factor", num("r.reserve_factor")), ("collateral_supply_cap", "CAST(cents * 1000 AS VARCHAR)")]
    terms = [("category_id", "CAST(category_id AS VARCHAR)"), ("label", "label"), ("ltv", num("CAST(ltv AS DOUBLE) / 1e4")), ("lt", num("CAST(lt AS DOUBLE) / 1e4")),
             ("bonus", num("CAST(bonus - 10000 AS DOUBLE) / 1e4"))]
    groups = [
        ("v_reserve_update", "true", [("block_number", "CAST(evt_block_number AS VARCHAR)")], "evt_block_number"),
        ("v_reserve_update", "true", [("block_time_utc", "strftime(evt_block_time, '%Y-%m-%d %H:%M:%S')")], "evt_block_time"),
        ("sres r JOIN v_reserves v USING (reserve_index)", "reserve_index = 5", debt, "1"),
        ("sres r JOIN v_reserves v USING (reserve_index)", "reserve_index = 3", collateral, "1"),
        ("best_cat", "true", [(f"best_{p}", x) for p, x in terms], "1"),
        ("v_categories", "category_id = 16", [(f"reference_{p}", x) for p, x in terms], "1"),
        ("stake", "true", [("asset_total_supply", whole("sup")), ("staking_ratio", num("round(staked / NULLIF(sup, 0), 8)"))], "1"),
        ("(SELECT 1)", "true", [("net_yield", "'0.04000000'"), ("gross_yield", "'0.04570000'"), ("active_incentive", "'none observed'")], "1"),
    ]
    return [f"SELECT '{p}' AS param, (SELECT arg_max({x}, {order}) FROM {source} WHERE {where}) AS value" for source, where, rows, order in groups for p, x in rows]


CTES_MODEL: dict[str, str] = {
    "v_reserves": f"""SELECT reserve_index, address, symbol, ltv, liquidation_threshold, liquidation_bonus, reserve_factor,
        cents, upct, uopt, s1, s2, last_update,
        CAST(round(rate * 1e4) AS BIGINT) AS rate_bps,
        CAST(round(rate * u * (1.0{D} - CAST(reserve_factor AS DOUBLE) / 1e4) * 1e4) AS BIGINT) AS liq_bps
      FROM (SELECT *, CASE WHEN u <= uo THEN CAST(s1 AS DOUBLE) / 1e4 * u / uo
                           ELSE CAST(s1 AS DOUBLE) / 1e4 + CAST(s2 AS DOUBLE) / 1e4 * (u - uo) / (1.0{D} - uo) END AS rate
            FROM (SELECT CAST(s_suppkey AS INTEGER) AS reserve_index, ('0xc' || lpad(lower(hex(s_suppkey)), 39, '0')) AS address,
                         CASE WHEN s_acctbal >= 5000 THEN 'PT-' ELSE 'T' END || CAST(s_suppkey AS VARCHAR) AS symbol,
                         7000 + (s_suppkey % 20) * 100 AS ltv, 7300 + (s_suppkey % 20) * 100 AS liquidation_threshold,
                         10100 + (s_suppkey % 5) * 100 AS liquidation_bonus, 1000 + (s_suppkey % 4) * 500 AS reserve_factor,
                         CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS cents, 40 + s_suppkey % 55 AS upct,
                         8000 + (s_suppkey % 3) * 500 AS uopt, 300 + (s_suppkey % 4) * 100 AS s1, 6000 + (s_suppkey % 5) * 1000 AS s2,
                         788918400 + s_suppkey * 86400 AS last_update,
                         CAST(40 + s_suppkey % 55 AS DOUBLE) / 100.0{D} AS u,
                         CAST(8000 + (s_suppkey % 3) * 500 AS DOUBLE) / 1e4 AS uo
                  FROM supplier) a) b""",
    "sres": f"""SELECT reserve_index, address,
        round(CAST(ltv AS DOUBLE) / 1e4, 8) AS ltv, round(CAST(liquidation_threshold AS DOUBLE) / 1e4, 8) AS liquidation_threshold,
        round(CAST(liquidation_bonus - 10000 AS DOUBLE) / 1e4, 8) AS liquidation_bonus,
        round(CAST(reserve_factor AS DOUBLE) / 1e4, 8) AS reserve_factor,
        round(CAST(CAST(cents AS HUGEINT) * CAST('10000000000000000000000' AS HUGEINT) AS DOUBLE) / 1e18, 4) AS total_supplied,
        round(CAST(CAST(cents AS HUGEINT) * upct * CAST('100000000000000000000' AS HUGEINT) AS DOUBLE) / 1e18, 4) AS total_variable_debt,
        round(CAST(CAST(liq_bps AS HUGEINT) * CAST('100000000000000000000000' AS HUGEINT) AS DOUBLE) / 1e27, 8) AS supply_rate,
        round(CAST(CAST(rate_bps AS HUGEINT) * CAST('100000000000000000000000' AS HUGEINT) AS DOUBLE) / 1e27, 8) AS borrow_rate,
        DATE '1970-01-01' + CAST(last_update // 86400 AS INTEGER) AS last_update_day,
        round(CAST(uopt AS DOUBLE) / 1e4, 8) AS uopt, round(0.0{D} / 1e4, 8) AS base_rate,
        round(CAST(s1 AS DOUBLE) / 1e4, 8) AS slope1, round(CAST(s2 AS DOUBLE) / 1e4, 8) AS slope2
      FROM v_reserves""",
    "v_categories": """SELECT CAST(p_partkey AS INTEGER) AS category_id, p_brand AS label,
        list_sort(list_distinct([CAST(p_partkey % 10 AS BIGINT), CAST(p_size % 10 AS BIGINT)] || CASE WHEN p_partkey % 50 = 7 THEN [30::BIGINT, 32] ELSE [] END
          || CASE WHEN p_partkey % 3 = 1 THEN [CAST(64 + p_partkey % 64 AS BIGINT)] ELSE [] END || CASE WHEN p_partkey % 97 = 5 THEN range(96, 128) ELSE [] END)) AS coll_bits,
        list_sort(list_distinct([CAST(p_partkey % 7 AS BIGINT), CAST(p_size % 6 AS BIGINT)] || CASE WHEN p_partkey % 50 = 7 THEN [31::BIGINT] ELSE [] END
          || CASE WHEN p_partkey % 4 = 2 THEN [CAST(64 + p_size % 64 AS BIGINT)] ELSE [] END)) AS borr_bits,
        9000 + p_size * 10 AS ltv, 9200 + p_size * 10 AS lt, CAST(10000 + p_partkey % 500 AS INTEGER) AS bonus FROM part""",
    "cands": "SELECT * FROM v_categories WHERE list_contains(coll_bits, 3) AND list_contains(borr_bits, 5)",
    "v_lineage": """SELECT r.address AS token, 'SY' AS relation, ('0xb' || lpad(lower(hex(s.s_nationkey)), 39, '0')) AS target
        FROM v_reserves r JOIN supplier s ON s.s_suppkey = r.reserve_index WHERE r.symbol LIKE 'PT-%'
      UNION ALL SELECT ('0xb' || lpad(lower(hex(n_nationkey)), 39, '0')), 'yieldToken', ('0xa' || lpad(lower(hex(n_regionkey)), 39, '0'))
        FROM nation""",
    "resolved": """SELECT r.reserve_index, r.address, r.symbol, sy.target AS sy, yt.target AS yield_token FROM v_reserves r
        LEFT JOIN (SELECT * FROM v_lineage WHERE relation = 'SY') sy ON sy.token = r.address
        LEFT JOIN (SELECT * FROM v_lineage WHERE relation = 'yieldToken') yt ON yt.token = sy.target""",
    "cmembers": """SELECT category_id, unnest(coll_bits) AS reserve_index FROM cands""",
    "pure": f"""SELECT c.*, COALESCE(p.all_ok, TRUE) AS is_pure FROM cands c LEFT JOIN (
        SELECT m.category_id, bool_and(COALESCE(r.yield_token = {TGT}, FALSE)) AS all_ok
        FROM cmembers m LEFT JOIN resolved r ON r.reserve_index = m.reserve_index WHERE m.reserve_index <> 3
        GROUP BY 1) p ON p.category_id = c.category_id""",
    "best_cat": "SELECT * FROM pure WHERE is_pure ORDER BY ltv DESC, bonus ASC, category_id ASC LIMIT 1",
    "tsupply": f"""SELECT contract_address AS token,
        SUM(CASE WHEN "from" = {Z} THEN value WHEN "to" = {Z} THEN -value ELSE 0 END) AS total_supply,
        SUM(CASE WHEN "to" = {VAULT} THEN value WHEN "from" = {VAULT} THEN -value ELSE 0 END) AS vault_balance
      FROM v_transfer GROUP BY 1""",
    "stake": f"""SELECT CAST(SUM(CASE WHEN token = {A} THEN total_supply END) AS DOUBLE) / {U} AS sup,
        CAST(SUM(CASE WHEN token = {A} THEN vault_balance END) AS DOUBLE) / {U} AS staked,
        CAST(SUM(CASE WHEN token = {SH} THEN total_supply END) AS DOUBLE) / {U} AS shares FROM tsupply WHERE token IN ({A}, {SH})""",
    "prow": """SELECT r.ltv AS debt_reserve_ltv, r.reserve_factor AS debt_reserve_factor, r.uopt AS ir_uopt, r.base_rate AS ir_base,
        r.slope1 AS ir_slope1, r.slope2 AS ir_slope2, r.borrow_rate AS debt_borrow_rate, r.supply_rate AS debt_supply_rate,
        round(r.total_variable_debt / r.total_supplied, 8) AS debt_utilisation,
        CAST(b.category_id AS DOUBLE) AS best_category_id, round(CAST(b.ltv AS DOUBLE) / 1e4, 8) AS best_category_ltv,
        round(CAST(b.lt AS DOUBLE) / 1e4, 8) AS best_category_lt, round(CAST(b.bonus - 10000 AS DOUBLE) / 1e4, 8) AS best_category_bonus,
        round(st.staked / NULLIF(st.sup, 0), 8) AS staking_ratio, round(st.staked / NULLIF(st.shares, 0), 8) AS exchange_rate
      FROM sres r CROSS JOIN best_cat b CROSS JOIN stake st WHERE r.reserve_index = 5""",
    "cl_top": "SELECT address, debt, leverage, health_factor FROM normal_acc WHERE address IN (SELECT address FROM loopers) ORDER BY debt DESC, address LIMIT 10",
    "cl": f"SELECT * FROM cl_top WHERE address NOT IN (SELECT address FROM cl_top WHERE leverage < 5.0{D})",
    "cstats": f"""SELECT COUNT(*) AS n_members, SUM(debt) AS cluster_debt,
        SUM(debt * leverage) / NULLIF(SUM(debt), 0) AS w_leverage, SUM(debt * health_factor) / NULLIF(SUM(debt), 0) AS w_hf,
        SUM(debt * {roe('leverage', '0.033' + D)}) / NULLIF(SUM(debt), 0) AS hurdle,
        MIN({roe('leverage', '0.033' + D)}) AS roe_min, MAX({roe('leverage', '0.033' + D)}) AS roe_max,
        SUM(debt) / NULLIF((SELECT CAST(SUM(debt_raw) AS DOUBLE) / {U} FROM loopers), 0) AS share_of_loop_debt FROM cl""",
    "sens_sc": f"""SELECT * FROM (VALUES ('HF = 1.025', 'hf', 1.025{D}), ('HF = 1.05', 'hf', 1.05{D}), ('HF = 1.1', 'hf', 1.10{D}),
        ('L = 10x', 'l', 10.0{D}), ('L = base', 'base', NULL), ('L = 12x', 'l', 12.0{D})) t(scenario, kind, target)""",
    "sens_l": f"""SELECT sc.scenario, sc.kind, sc.target, st.hurdle, st.w_hf,
        CASE WHEN sc.kind = 'hf' THEN 1.0{D} / (1.0{D} - 0.94{D} / sc.target) WHEN sc.kind = 'l' THEN sc.target ELSE st.w_leverage END AS L
        FROM sens_sc sc CROSS JOIN cstats st""",
    "sens": f"""SELECT scenario, L,
        CASE WHEN kind = 'hf' THEN target WHEN kind = 'l' THEN 0.94{D} / (1.0{D} - 1.0{D} / L) ELSE w_hf END AS HF,
        {eq('0.90' + D, '0.04' + D)} FROM sens_l""",
    "cfgs": f"""SELECT * FROM (VALUES ('Status quo', 0.90{D}, 0.04{D}), ('A: lower Uopt', 0.80{D}, 0.04{D}),
        ('B: raise slope1', 0.90{D}, 0.07{D}), ('C: moderate both', 0.85{D}, 0.055{D})) t(config, uopt, slope1)""",
    "cfg_eq": f"""SELECT config, uopt, slope1, {eq()} FROM (SELECT c.config, c.uopt, c.slope1, st.hurdle, st.w_leverage AS L
        FROM cfgs c CROSS JOIN cstats st) q""",
    "cfg_cmp": f"""SELECT e.*, e.revenue / b.revenue - 1.0{D} AS revenue_change, (e.u_star - b.u_star) * 100.0{D} AS u_change_points
        FROM cfg_eq e CROSS JOIN (SELECT revenue, u_star FROM cfg_eq WHERE config = 'Status quo') b""",
    "sweep": f"""SELECT slope1, {eq('0.90' + D, 'slope1')} FROM (SELECT s.slope1, st.hurdle, st.w_leverage AS L FROM (SELECT * FROM (VALUES
        (0.02{D}), (0.03{D}), (0.034{D}), (0.04{D}), (0.05{D}), (0.07{D}), (0.10{D}), (0.15{D}), (0.20{D})) t(slope1)) s
        CROSS JOIN cstats st) q""",
}

BODIES_MODEL: dict[str, str] = {
    "category_candidates": """SELECT category_id, label, round(CAST(ltv AS DOUBLE) / 1e4, 8) AS ltv, round(CAST(lt AS DOUBLE) / 1e4, 8) AS lt,
        round(CAST(bonus - 10000 AS DOUBLE) / 1e4, 8) AS bonus FROM cands""",
    "category_pure_flag": "SELECT category_id, is_pure FROM pure",
    "category_coverage": """SELECT MAX(CASE WHEN len(coll_bits) > 0 OR len(borr_bits) > 0 THEN category_id END) AS max_configured_id,
        COUNT(CASE WHEN len(coll_bits) > 0 OR len(borr_bits) > 0 THEN 1 END) AS n_configured,
        MAX(CASE WHEN len(coll_bits) > 0 OR len(borr_bits) > 0 THEN category_id END) >= 900000 AS near_scan_bound FROM v_categories""",
    "token_lineage": f"SELECT reserve_index, address, symbol, sy, yield_token, COALESCE(yield_token = {TGT}, FALSE) AS resolves_to_target FROM resolved",
    "best_category": """SELECT category_id, label, round(CAST(ltv AS DOUBLE) / 1e4, 8) AS ltv, round(CAST(lt AS DOUBLE) / 1e4, 8) AS lt,
        round(CAST(bonus - 10000 AS DOUBLE) / 1e4, 8) AS bonus FROM best_cat""",
    "max_leverage_roe": f"""SELECT category_id, round(x, 8) AS ltv, round(L, 8) AS max_leverage, round(1000.0{D} * L, 8) AS collateral,
        round(1000.0{D} * (L - 1.0{D}), 8) AS debt, round({roe('L', '0.032' + D)}, 8) AS roe
        FROM (SELECT category_id, x, 1.0{D} / (1.0{D} - x) AS L FROM (SELECT category_id, CAST(ltv AS DOUBLE) / 1e4 AS x FROM cands))""",
    "category_baskets": f"""SELECT m.category_id, CAST(m.reserve_index AS INTEGER) AS reserve_index, r.address, r.symbol,
        CASE WHEN COALESCE(r.symbol LIKE 'PT-%', FALSE) THEN r.yield_token END AS yield_token,
        CASE WHEN COALESCE(r.symbol LIKE 'PT-%', FALSE) THEN COALESCE(r.yield_token = {TGT}, FALSE) END AS yield_is_target
        FROM cmembers m LEFT JOIN resolved r ON r.reserve_index = m.reserve_index""",
    "scale_units": "SELECT * FROM sres",
    "curve_rate": f"""SELECT reserve_index, round(u, 8) AS utilisation, round(implied, 8) AS implied_rate, borrow_rate AS stored_rate,
        round(implied - borrow_rate, 8) AS rate_gap FROM (
        SELECT reserve_index, u, borrow_rate, CASE WHEN u <= uopt THEN base_rate + slope1 * (u / uopt)
            ELSE base_rate + slope1 + slope2 * ((u - uopt) / (1.0{D} - uopt)) END AS implied
        FROM (SELECT *, total_variable_debt / total_supplied AS u FROM sres))""",
    "staking_state": """SELECT sup AS asset_total_supply, staked AS asset_staked, shares AS vault_shares,
        round(staked / NULLIF(sup, 0), 8) AS staking_ratio, round(staked / NULLIF(shares, 0), 8) AS exchange_rate FROM stake""",
    "param_table": "SELECT param, value FROM (UNPIVOT prow ON COLUMNS(*) INTO NAME param VALUE value)",
    "setup_table": " UNION ALL ".join(_setup_rows()),
    "params_as_json": "SELECT CAST(to_json(struct_pack(" + ", ".join(f"{p} := printf('%.8f', {p})" for p in PARAMS) + ")) AS VARCHAR) AS params_json FROM prow",
    "integrity_checks": f"""SELECT 'reserve_index_unique' AS rule, CAST(SUM(n) AS BIGINT) AS n_checked,
            CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS n_bad
          FROM (SELECT reserve_index, COUNT(*) AS n FROM v_reserves GROUP BY 1)
        UNION ALL SELECT 'reserve_address_unique', CAST(SUM(n) AS BIGINT), CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n END), 0) AS BIGINT)
          FROM (SELECT address, COUNT(*) AS n FROM v_reserves GROUP BY 1)
        UNION ALL SELECT 'category_bit_has_reserve', COUNT(*), COUNT(CASE WHEN r.reserve_index IS NULL THEN 1 END)
          FROM (SELECT category_id, unnest(coll_bits) AS i FROM v_categories) m
          LEFT JOIN (SELECT DISTINCT reserve_index FROM v_reserves) r ON r.reserve_index = m.i
        UNION ALL SELECT 'sy_hop_resolves', COUNT(*), COUNT(CASE WHEN y.token IS NULL THEN 1 END)
          FROM (SELECT * FROM v_lineage WHERE relation = 'SY') s
          LEFT JOIN (SELECT DISTINCT token FROM v_lineage WHERE relation = 'yieldToken') y ON y.token = s.target
        UNION ALL SELECT 'update_key_unique', CAST(SUM(n) AS BIGINT), CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n END), 0) AS BIGINT)
          FROM (SELECT reserve, evt_block_number, evt_index, COUNT(*) AS n FROM v_reserve_update GROUP BY 1, 2, 3)
        UNION ALL SELECT 'transfer_not_to_self', COUNT(*), COUNT(CASE WHEN "from" = "to" AND "from" <> {Z} THEN 1 END) FROM v_transfer""",
    "cluster_excluding": "SELECT address, debt, round(leverage, 8) AS leverage, round(health_factor, 8) AS health_factor FROM cl",
    "cluster_hurdle": """SELECT n_members, round(cluster_debt, 4) AS cluster_debt, round(w_leverage, 8) AS w_leverage, round(w_hf, 8) AS w_hf,
        round(hurdle, 8) AS hurdle, round(roe_min, 8) AS roe_min, round(roe_max, 8) AS roe_max,
        round(share_of_loop_debt, 8) AS share_of_loop_debt FROM cstats""",
    "equilibrium": f"SELECT {EQCOLS} FROM (SELECT {EQ_SQ} FROM (SELECT hurdle, w_leverage AS L FROM cstats))",
    "curve_inverse": f"""SELECT day, borrow_apr,
        round(CASE WHEN borrow_apr <= 0.0{D} + 0.04{D} THEN 0.90{D} * (borrow_apr - 0.0{D}) / 0.04{D}
            ELSE 0.90{D} + (1.0{D} - 0.90{D}) * (borrow_apr - 0.0{D} - 0.04{D}) / 0.12{D} END, 8) AS implied_utilisation,
        CASE WHEN borrow_apr <= 0.0{D} + 0.04{D} THEN 'below kink' ELSE 'above kink' END AS branch FROM rate_daily""",
    "scenario_grid": f"""SELECT a.address, r.borrow_rate, round(a.leverage, 8) AS leverage, round({roe('a.leverage', 'r.borrow_rate')}, 8) AS roe
        FROM normal_acc a CROSS JOIN (SELECT * FROM (VALUES (0.02{D}), (0.025{D}), (0.03{D}), (0.033{D}),
            (0.035{D}), (0.04{D})) t(borrow_rate)) r""",
    "hf_leverage_map": f"""SELECT address, round(health_factor, 8) AS health_factor, round(leverage, 8) AS leverage,
        round(1.0{D} / (1.0{D} - liquidation_threshold / health_factor), 8) AS leverage_from_hf,
        round(liquidation_threshold / (1.0{D} - 1.0{D} / leverage), 8) AS hf_from_leverage FROM normal_acc""",
    "sensitivity_table": f"""SELECT scenario, round(L, 8) AS leverage, round(HF, 8) AS health_factor, {EQCOLS},
        ROW_NUMBER() OVER (ORDER BY revenue ASC, scenario ASC) AS revenue_rank FROM sens""",
    "scenario_range": """SELECT round(MIN(revenue), 4) AS revenue_min, round(MAX(revenue), 4) AS revenue_max,
        round(MIN(revenue) / 1e9 * 1e4, 8) AS bps_min, round(MAX(revenue) / 1e9 * 1e4, 8) AS bps_max FROM sens""",
    "curve_configs": f"""SELECT config, uopt, slope1, {EQCOLS}, round(revenue_change, 8) AS revenue_change,
        round(u_change_points, 8) AS u_change_points FROM cfg_cmp""",
    "config_table_text": """SELECT config, printf('%.0f%%', round(uopt * 100, 0)) AS uopt_text, printf('%.1f%%', round(slope1 * 100, 1)) AS slope1_text,
        printf('%.2f%%', round(u_star * 100, 2)) AS u_star_text, printf('%.2f%%', round(r_star * 100, 2)) AS r_star_text,
        printf('$%.2fM', round(revenue / 1e6, 2)) AS revenue_text, printf('%.2f%%', round(supply_apy * 100, 2)) AS supply_apy_text, branch
        FROM cfg_cmp""",
    "slope_sweep": "SELECT slope1, round(u_star, 8) AS u_star, branch, round(revenue, 4) AS revenue FROM sweep",
    "sweep_monotone": """SELECT COUNT(*) AS n_points, COALESCE(bool_and(CASE WHEN prev IS NOT NULL THEN revenue <= prev END), TRUE) AS is_non_increasing
        FROM (SELECT slope1, revenue, LAG(revenue) OVER (ORDER BY slope1) AS prev FROM sweep)""",
    "fit_gap": f"""SELECT round(o.observed_u, 8) AS observed_u, round(b.u_star, 8) AS u_star, round(b.u_star - o.observed_u, 8) AS gap,
        round(a.u_star, 8) AS u_star_placeholder, round(a.u_star - o.observed_u, 8) AS gap_placeholder
        FROM (SELECT {EQ_SQ} FROM (SELECT hurdle, w_leverage AS L FROM cstats)) b
        CROSS JOIN (SELECT {EQ_ALT} FROM (SELECT hurdle, w_leverage AS L FROM cstats)) a
        CROSS JOIN (SELECT arg_max(CASE WHEN borrow_apr > 0 THEN supply_apr / (borrow_apr * (1.0{D} - 0.25{D})) END, day) AS observed_u
                    FROM rate_daily) o""",
}
