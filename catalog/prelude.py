"""Common table expressions of the SQL checks: the shared tables as engine inputs.

Written on their own, for DuckDB, so that they check the DataFrame side
instead of repeating it.
"""

from __future__ import annotations

from tradelanes.plans.shared_tables import CLASSES, CODES, DECISIONS, TOKENS

# ---------------------------------------------------------------- fixed values
# What alerts count for, written out once more: a check that took the engine's
# own lists would agree with any mistake in them.

CLASSIFICATIONS = [
    ("alert notification", "AlertNotification"),
    ("alert", "AlertNotification"),
    ("border rejection", "BorderRejection"),
    ("border rejection notification", "BorderRejection"),
    ("information for follow-up", "InfoFollowUp"),
    ("information notification for follow-up", "InfoFollowUp"),
    ("information for attention", "InfoAttention"),
    ("information notification for attention", "InfoAttention"),
]
CLASSIFICATION_WEIGHTS = [
    ("AlertNotification", 1.0),
    ("BorderRejection", 0.8),
    ("InfoFollowUp", 0.7),
    ("InfoAttention", 0.5),
]
RISK_DECISIONS = [
    ("serious", "Serious"),
    ("potentially serious", "PotentiallySerious"),
    ("potential risk", "PotentialRisk"),
    ("not serious", "NotSerious"),
    ("undecided", "PotentialRisk"),
]
RISK_DECISION_WEIGHTS = [
    ("Serious", 1.0),
    ("PotentiallySerious", 0.7),
    ("PotentialRisk", 0.4),
    ("NotSerious", 0.2),
]
HAZARD_TOKENS = [
    ("biological", "biological"),
    ("pathogenic micro-organisms", "biological"),
    ("non-pathogenic micro-organisms", "biological"),
    ("parasitic infestation", "biological"),
    ("biocontaminants", "biological"),
    ("pesticide residues", "chem_pesticides"),
    ("industrial contaminants", "chem_pesticides"),
    ("heavy metals", "chem_heavy_metals"),
    ("metals", "chem_heavy_metals"),
    ("mycotoxins", "chem_mycotoxins"),
    ("natural toxins", "chem_mycotoxins"),
    ("natural toxins (other)", "chem_mycotoxins"),
    ("chemical contamination", "chem_other"),
    ("food additives and flavourings", "chem_other"),
    ("migration", "chem_other"),
    ("foreign bodies", "chem_other"),
    ("allergens", "chem_other"),
    ("residues of veterinary medicinal products", "chem_other"),
    ("veterinary medicinal products", "chem_other"),
    ("radiation", "chem_other"),
    ("other hazard", "chem_other"),
    ("process contaminants", "chem_other"),
    ("polycyclic aromatic hydrocarbons", "chem_other"),
    ("composition", "regulatory"),
    ("labelling absent/incomplete/incorrect", "regulatory"),
    ("labelling", "regulatory"),
    ("adulteration/fraud", "regulatory"),
    ("adulteration", "regulatory"),
    ("novel food", "regulatory"),
    ("gmo / novel food", "regulatory"),
    ("gmo", "regulatory"),
    ("tampering", "regulatory"),
    ("poor or insufficient controls", "regulatory"),
]
# ------------------------------------------------------------------------------


def cases(column: str, options: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in options.items()) + " END"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


FAMILIES = [
    "biological",
    "chem_pesticides",
    "chem_heavy_metals",
    "chem_mycotoxins",
    "chem_other",
    "regulatory",
]
FAMILY_LIST = ", ".join(FAMILIES)
CODE = cases("p_type", CODES)
TOKEN = "CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOKENS)) + " END"

_TRADE = """
SELECT period, {r}_nationkey + 1 AS "reporterCode", 'NATION_' || {r}_nationkey AS "reporterDesc",
       {p}_nationkey + 1 AS "partnerCode", 'NATION_' || {p}_nationkey AS "partnerDesc",
       code AS "cmdCode", 'Goods; of ' || lower(p_type) || ' (other)' AS "cmdDesc",
       '{flow}' AS "flowCode", '{desc}' AS "flowDesc", l_extendedprice AS "primaryValue",
       CASE WHEN l_orderkey % 101 <> 7 THEN l_quantity END AS "netWgt", l_quantity AS qty,
       CASE WHEN l_linenumber = 1 THEN 'N/A' ELSE 'kg' END AS "qtyUnitAbbr"
FROM lines WHERE c_nationkey <> s_nationkey {extra}
"""


def _pieces(column: str, name: str, order: int) -> str:
    return f"""
SELECT row_id, '{name}' AS role, {order} AS role_ord, generate_subscripts(parts, 1) AS pos,
       trim(unnest(parts)) AS name
FROM (SELECT row_id, string_split({column}, ',') AS parts FROM raw
      WHERE {column} IS NOT NULL AND lower(trim({column})) <> 'nan')"""


PRELUDE: dict[str, str] = {
    "book": """
SELECT n_nationkey AS ord, n_name AS name, n_nationkey + 1 AS m49, (r_name = 'EUROPE') AS is_eu27
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "lines": f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag,
       CAST(year(o_orderdate) AS INTEGER) AS period, c_nationkey, s_nationkey, p_type, p_size, {CODE} AS code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "trade": _TRADE.format(r="c", p="s", flow="M", desc="Import", extra="")
    + " UNION ALL "
    + _TRADE.format(r="s", p="c", flow="X", desc="Export", extra="AND l_returnflag <> 'R'"),
    "exports": """SELECT * FROM trade WHERE "flowCode" = 'X'""",
    "routed": """SELECT *, "reporterDesc" || ' → ' || "partnerDesc" AS route FROM exports""",
    "population": """
SELECT c_nationkey + 1 AS country_m49, CAST(count(*) AS DOUBLE) AS population FROM customer GROUP BY 1""",
    "production": """
SELECT commodity_hs, country_m49, period, production_kg,
       CASE WHEN country_m49 % 3 = 2 THEN production_kg * 2 WHEN country_m49 % 3 = 1 THEN 0.0 END AS domestic_supply_kg,
       population
FROM (SELECT code AS commodity_hs, s_nationkey + 1 AS country_m49, period, sum(l_quantity) AS production_kg
      FROM lines GROUP BY 1, 2, 3) LEFT JOIN population USING (country_m49)""",
    "balance": """
SELECT commodity_hs, country_m49, period, domestic_supply_food_kg, population
FROM (SELECT code AS commodity_hs, c_nationkey + 1 AS country_m49, period, sum(l_quantity) AS domestic_supply_food_kg
      FROM lines GROUP BY 1, 2, 3) LEFT JOIN population USING (country_m49)""",
    "commodities": f"""
SELECT p_name AS commodity, CASE WHEN p_size <> 13 THEN {CODE} END AS hs_code, min(p_partkey) AS pos
FROM part GROUP BY 1, 2""",
    "hs_names": """
SELECT hs_code, string_agg(commodity, ';' ORDER BY pos, commodity) AS names,
       list(commodity ORDER BY pos, commodity) AS name_list, count(*) AS n
FROM commodities WHERE hs_code IS NOT NULL GROUP BY 1""",
    # ------------------------------------------------------------- raw alerts
    "returned": f"""
SELECT l_orderkey, max(code) AS code, max(p_type) AS kind, min(token) AS token_a, max(token) AS token_b
FROM (SELECT l_orderkey, {CODE} AS code, p_type, {TOKEN} AS token
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
      WHERE l_returnflag = 'R') GROUP BY 1""",
    "sellers": """
SELECT l_orderkey, string_agg('NATION_' || s_nationkey, ', ' ORDER BY s_nationkey) AS sellers
FROM (SELECT DISTINCT l_orderkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      WHERE l_returnflag = 'R') GROUP BY 1""",
    "raw": f"""
SELECT o_orderkey AS row_id, 'R' || (o_orderkey // 2) AS reference,
  CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CASE WHEN o_orderkey % 34 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS notification_date,
  CASE WHEN o_orderkey % 97 = 0 THEN 'Atlantis' WHEN o_orderkey % 89 = 0 THEN NULL
       WHEN o_orderkey % 29 = 0 THEN sellers || ', Atlantis'
       WHEN o_orderkey % 13 = 0 THEN 'Republic of ' || sellers ELSE sellers END AS origin,
  CASE WHEN o_orderkey % 4 = 1 THEN 'nation_' || c_nationkey ELSE 'NATION_' || c_nationkey END AS notifying_country,
  CASE WHEN o_orderkey % 5 = 2 THEN NULL
       WHEN o_orderkey % 6 = 0 THEN 'NATION_' || (o_orderkey % 25) || ', Elsewhere'
       ELSE 'NATION_' || (o_orderkey % 25) END AS distribution,
  CASE WHEN o_orderkey % 7 <> 3
       THEN 'NATION_' || (o_custkey % 25) || ',NATION_' || ((o_orderkey * 7 + 3) % 25) END AS for_followup,
  CASE WHEN o_orderkey % 9 = 0 THEN ' nan' WHEN o_orderkey % 3 = 1 THEN 'NATION_' || (o_orderkey % 23) END AS for_attention,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN code || '.0' ELSE code END AS hs_code,
  CASE WHEN o_orderkey % 37 <> 0 THEN 'goods ' || lower(kind) END AS commodities,
  {cases("o_orderpriority", CLASSES)} AS classification,
  CASE WHEN o_orderkey % 11 = 0 THEN 'not serious' ELSE {cases("o_orderstatus", DECISIONS)} END AS risk_decision,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN token_a
       ELSE 'a - {{' || token_a || '}},b - {{ ' || token_b || ' }}' END AS hazards
FROM orders JOIN returned ON o_orderkey = returned.l_orderkey JOIN sellers ON o_orderkey = sellers.l_orderkey
JOIN customer ON o_custkey = c_custkey""",
    # --------------------------------------------------------- parsed columns
    "cleaned": """
SELECT row_id, reference,
  CASE WHEN hs_code IS NULL THEN ''
       WHEN TRY_CAST(hs_code AS DOUBLE) IS NOT NULL
       THEN CAST(CAST(trunc(TRY_CAST(hs_code AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE trim(hs_code) END AS commodity_hs,
  coalesce(commodities, '') AS commodity_name, coalesce(classification, '') AS classification,
  coalesce(risk_decision, '') AS risk_decision,
  CASE WHEN hazards IS NULL THEN ''
       WHEN len(regexp_extract_all(trim(hazards), '\\{([^}]+)\\}', 1)) > 0
       THEN array_to_string([trim(x) FOR x IN regexp_extract_all(trim(hazards), '\\{([^}]+)\\}', 1)], ',')
       ELSE trim(hazards) END AS hazard_category,
  CASE WHEN coalesce(date, notification_date) IS NULL THEN 0
       ELSE CAST(year(CAST(coalesce(date, notification_date) AS DATE)) * 100
                 + month(CAST(coalesce(date, notification_date) AS DATE)) AS INTEGER) END AS period
FROM raw""",
    "pieces": " UNION ALL ".join(
        [
            _pieces("origin", "origin", 0),
            _pieces("notifying_country", "notifier", 1),
            _pieces("distribution", "distribution", 2),
            _pieces("for_followup", "followUp", 3),
            _pieces("for_attention", "attention", 4),
        ]
    ),
    "name_map": """
SELECT name, coalesce(
    (SELECT arg_min(b.m49, b.ord) FROM book b WHERE lower(b.name) = lower(n.name)),
    (SELECT arg_min(b.m49, b.ord) FROM book b
     WHERE contains(lower(b.name), lower(n.name)) OR contains(lower(n.name), lower(b.name)))) AS m49
FROM (SELECT DISTINCT name FROM pieces WHERE name <> ''
      UNION SELECT DISTINCT trim(origin) FROM raw WHERE origin IS NOT NULL) n""",
    "mapped": """SELECT p.*, m.m49 FROM pieces p JOIN name_map m ON p.name = m.name""",
    "origins": """
SELECT row_id, pos, name AS origin_country, m49 AS origin_m49 FROM mapped
WHERE role = 'origin' AND m49 IS NOT NULL""",
    "destinations": """
SELECT row_id, m49 AS destination_m49, arg_min(name, role_ord * 1000 + pos) AS destination_country,
       min(role_ord * 1000 + pos) AS seen, list_sort(list(DISTINCT role)) AS roles
FROM mapped WHERE role <> 'origin' AND m49 IS NOT NULL GROUP BY 1, 2""",
    "corridor_events": """
SELECT c.*, o.origin_country, o.origin_m49, d.destination_country, d.destination_m49, d.roles,
       c.row_id * 100000000 + o.pos * 100000 + d.seen AS ord,
       (list_contains(d.roles, 'notifier') OR list_contains(d.roles, 'distribution')
        OR list_contains(d.roles, 'followUp')) AS active
FROM cleaned c JOIN origins o USING (row_id) JOIN destinations d USING (row_id)
WHERE o.origin_m49 <> d.destination_m49""",
    # ------------------------------------------------------------- enumerations
    "classes": f"SELECT * FROM (VALUES {values(CLASSIFICATIONS)}) AS v(spelling, kind)",
    "decisions": f"SELECT * FROM (VALUES {values(RISK_DECISIONS)}) AS v(spelling, kind)",
    "class_weights": f"SELECT kind, w::DOUBLE AS w FROM (VALUES {values(CLASSIFICATION_WEIGHTS)}) AS v(kind, w)",
    "decision_weights": f"SELECT kind, w::DOUBLE AS w FROM (VALUES {values(RISK_DECISION_WEIGHTS)}) AS v(kind, w)",
    "tokens": "SELECT * FROM (VALUES "
    + values([(i, t, f) for i, (t, f) in enumerate(HAZARD_TOKENS)])
    + ") AS v(ord, token, family)",
    "token_texts": """
SELECT DISTINCT trim(unnest(string_split(hazard_category, ','))) AS txt FROM cleaned
UNION SELECT DISTINCT trim(hazard_category) FROM cleaned""",
    "families": """
SELECT txt, coalesce(
    (SELECT arg_min(k.family, k.ord) FROM tokens k WHERE k.token = lower(t.txt)),
    (SELECT arg_min(k.family, k.ord) FROM tokens k WHERE contains(lower(t.txt), k.token)), 'chem_other') AS family
FROM token_texts t""",
    "notif_first": """
SELECT reference, origin_m49, list_sort(list(DISTINCT destination_m49)) AS affected,
       arg_min(commodity_hs, ord) AS commodity_hs, arg_min(classification, ord) AS c0,
       arg_min(risk_decision, ord) AS r0, arg_min(hazard_category, ord) AS h0, arg_min(period, ord) AS period
FROM corridor_events GROUP BY 1, 2""",
    "notif": """
SELECT n.reference, n.commodity_hs, n.origin_m49, n.affected,
       coalesce(c.kind, 'InfoAttention') AS classification, coalesce(d.kind, 'PotentialRisk') AS risk_decision,
       f.family AS hazard_type, n.period
FROM notif_first n LEFT JOIN classes c ON c.spelling = lower(trim(n.c0))
LEFT JOIN decisions d ON d.spelling = lower(trim(n.r0)) LEFT JOIN families f ON f.txt = trim(n.h0)
WHERE n.commodity_hs <> '' AND n.period <> 0""",
    "cur": "SELECT coalesce(max(period), 202600) AS cur_period FROM notif",
    "category_map": """
SELECT reference, arg_min(hazard_category, ord) AS hazard_category FROM corridor_events WHERE reference <> '' GROUP BY 1""",
    "notif_tokens": """
SELECT reference, origin_m49, f.family FROM (
  SELECT n.reference, n.origin_m49, trim(unnest(string_split(m.hazard_category, ','))) AS txt
  FROM notif n JOIN category_map m USING (reference)) t JOIN families f ON f.txt = t.txt WHERE t.txt <> ''""",
    "notif_shares": f"""
SELECT n.reference, n.origin_m49, {", ".join(
    f"CASE WHEN max(k.n) IS NULL THEN (CASE WHEN n.hazard_type = '{f}' THEN 1.0::DOUBLE ELSE 0.0 END) "
    f"ELSE coalesce(max(k.{f}), 0) / max(k.n) END AS {f}" for f in FAMILIES)}
FROM notif n LEFT JOIN (SELECT reference, origin_m49, count(*) AS n, {", ".join(
    f"CAST(count(*) FILTER (WHERE family = '{f}') AS DOUBLE) AS {f}" for f in FAMILIES)}
  FROM notif_tokens GROUP BY 1, 2) k ON k.reference = n.reference AND k.origin_m49 = n.origin_m49
GROUP BY n.reference, n.origin_m49, n.hazard_type""",
    "touched": f"""
SELECT n.reference, n.commodity_hs, n.origin_m49, unnest(n.affected) AS destination_m49, n.period,
       cw.w * dw.w AS severity, {", ".join(f"s.{f}" for f in FAMILIES)}
FROM notif n JOIN class_weights cw ON cw.kind = n.classification
JOIN decision_weights dw ON dw.kind = n.risk_decision
JOIN notif_shares s ON s.reference = n.reference AND s.origin_m49 = n.origin_m49""",
    "hazard_sums": f"""
SELECT commodity_hs, destination_m49, origin_m49,
       sum(severity * pow(0.9, greatest((cur_period // 100) * 12 + cur_period % 100
                                        - (period // 100) * 12 - period % 100, 0))) AS his,
       count(*) AS notification_count, sum(severity) AS severity_total,
       {", ".join(f"sum({f}) AS {f}" for f in FAMILIES)}
FROM touched CROSS JOIN cur GROUP BY 1, 2, 3""",
    "corridor_base": """
SELECT commodity_hs, destination_m49, origin_m49, arg_min(commodity_name, ord) AS commodity_name,
       arg_min(origin_country, ord) AS origin_country, arg_min(destination_country, ord) AS destination_country,
       count(*) AS event_count,
       count(*) FILTER (WHERE list_contains(roles, 'notifier')) AS role_notifier,
       count(*) FILTER (WHERE list_contains(roles, 'distribution')) AS role_distribution,
       count(*) FILTER (WHERE list_contains(roles, 'followUp')) AS "role_followUp",
       count(*) FILTER (WHERE list_contains(roles, 'attention')) AS role_attention,
       list_sort(list_distinct(flatten(list(roles)))) AS roles, bool_or(active) AS is_active_destination
FROM corridor_events WHERE commodity_hs <> '' GROUP BY 1, 2, 3""",
    "metrics": f"""
SELECT b.*, coalesce(s.his, 0.0) AS his, coalesce(s.notification_count, 0) AS notification_count,
       coalesce(s.severity_total, 0.0) AS severity_total, {", ".join(f"coalesce(s.{f}, 0.0) AS {f}" for f in FAMILIES)},
       CASE WHEN s.his IS NULL THEN 0.0 ELSE ({" + ".join(
    f"CASE WHEN s.{f} > 0 THEN -(s.{f} / tot) * ln(s.{f} / tot) ELSE 0.0 END" for f in FAMILIES)}) / ln(6.0) END AS hdi
FROM corridor_base b LEFT JOIN (SELECT *, {" + ".join(FAMILIES)} AS tot FROM hazard_sums) s
USING (commodity_hs, destination_m49, origin_m49)""",
    # ------------------------------------------------------------- trade metrics
    "bilateral": """
SELECT "cmdCode" AS commodity_hs, "reporterCode" AS destination_m49, "partnerCode" AS origin_m49, period,
       coalesce(sum("netWgt"), 0.0) AS bilateral_import_kg, coalesce(sum("primaryValue"), 0.0) AS import_usd,
       count(*) AS import_rows
FROM trade WHERE "flowCode" = 'M' GROUP BY 1, 2, 3, 4""",
    "export_sums": """
SELECT "cmdCode" AS commodity_hs, "reporterCode" AS country_m49, period, coalesce(sum("netWgt"), 0.0) AS total_exports_kg
FROM trade WHERE "flowCode" = 'X' GROUP BY 1, 2, 3""",
    "import_sums": """
SELECT commodity_hs, destination_m49, period, sum(bilateral_import_kg) AS total_imports_kg,
       CASE WHEN sum(bilateral_import_kg) > 0
            THEN sum(bilateral_import_kg * bilateral_import_kg) / pow(sum(bilateral_import_kg), 2) END AS hhi
FROM bilateral GROUP BY 1, 2, 3""",
    "lanes": """
SELECT b.*, i.total_imports_kg, coalesce(e.total_exports_kg, 0.0) AS total_exports_kg, i.hhi
FROM bilateral b JOIN import_sums i USING (commodity_hs, destination_m49, period)
LEFT JOIN export_sums e ON e.commodity_hs = b.commodity_hs AND e.country_m49 = b.destination_m49 AND e.period = b.period""",
    "dep0": """
SELECT l.*, coalesce(p.production_kg, 0.0) AS production_kg, p.domestic_supply_kg,
       CASE WHEN coalesce(p.production_kg, 0.0) + l.total_imports_kg - l.total_exports_kg > 0
            THEN coalesce(p.production_kg, 0.0) + l.total_imports_kg - l.total_exports_kg END AS ds_prime
FROM lanes l LEFT JOIN production p
ON p.commodity_hs = l.commodity_hs AND p.country_m49 = l.destination_m49 AND p.period = l.period""",
    "dep1": """
SELECT * REPLACE (CASE WHEN ds_prime IS NOT NULL THEN hhi END AS hhi), total_imports_kg / ds_prime AS idr,
       CASE WHEN ds_prime IS NOT NULL AND total_imports_kg > 0 THEN bilateral_import_kg / total_imports_kg END AS ocs,
       bilateral_import_kg / ds_prime AS bdi,
       CASE WHEN ds_prime IS NOT NULL THEN production_kg / coalesce(nullif(domestic_supply_kg, 0), ds_prime) END AS ssr,
       ds_prime IS NULL AS dq_flag
FROM dep0""",
    "dep": "SELECT *, idr * ocs * (1 + hhi) AS sci, idr * ocs * (1 + hhi) / 2 AS sci_half FROM dep1",
    "pcc": """
SELECT *, CASE WHEN population > 0 THEN domestic_supply_food_kg / population END AS pcc FROM balance""",
    "crs": """
SELECT *, CASE WHEN n <= 1 THEN 1.0 ELSE 1.0 - (rk - 1.0) / (n - 1.0) END AS crs FROM (
  SELECT *, row_number() OVER (PARTITION BY country_m49, period ORDER BY stable(pcc) DESC, commodity_hs) AS rk,
         count(*) OVER (PARTITION BY country_m49, period) AS n
  FROM pcc WHERE pcc IS NOT NULL)""",
    "pcc_short": """
SELECT * REPLACE (CAST(CAST(commodity_hs AS BIGINT) AS VARCHAR) AS commodity_hs) FROM pcc""",
    "crs_short": """
SELECT *, CASE WHEN n <= 1 THEN 1.0 ELSE 1.0 - (rk - 1.0) / (n - 1.0) END AS crs FROM (
  SELECT *, row_number() OVER (PARTITION BY country_m49, period ORDER BY stable(pcc) DESC, commodity_hs) AS rk,
         count(*) OVER (PARTITION BY country_m49, period) AS n
  FROM pcc_short WHERE pcc IS NOT NULL)""",
    "priced": """
SELECT *, CASE WHEN bilateral_import_kg > 0 THEN import_usd / bilateral_import_kg END AS unit_value FROM lanes""",
    "uv": """
SELECT *, CASE WHEN sd > abs(mu) * 1e-12 THEN (unit_value - mu) / sd END AS z_uv FROM (
  SELECT *, avg(unit_value) OVER w AS mu, stddev_samp(unit_value) OVER w AS sd FROM priced
  WINDOW w AS (PARTITION BY commodity_hs, destination_m49, period))""",
    "volume": """
SELECT *, CASE WHEN rolling_std > abs(rolling_mean) * 1e-12
               THEN (bilateral_import_kg - rolling_mean) / rolling_std END AS z_volume FROM (
  SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(bilateral_import_kg) OVER w END AS rolling_mean,
         CASE WHEN count(*) OVER w = 5 THEN stddev_samp(bilateral_import_kg) OVER w END AS rolling_std
  FROM lanes WINDOW w AS (PARTITION BY commodity_hs, destination_m49, origin_m49 ORDER BY period
                          ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""",
    "mirror": """
SELECT commodity_hs, destination_m49, origin_m49, period, coalesce(m.kg, 0.0) AS m_reported,
       coalesce(x.kg, 0.0) AS x_reported,
       CASE WHEN greatest(coalesce(m.kg, 0.0), coalesce(x.kg, 0.0)) > 0
            THEN abs(coalesce(m.kg, 0.0) - coalesce(x.kg, 0.0)) / greatest(coalesce(m.kg, 0.0), coalesce(x.kg, 0.0)) END AS mtd
FROM (SELECT commodity_hs, destination_m49, origin_m49, period, bilateral_import_kg AS kg FROM bilateral) m
FULL JOIN (SELECT "cmdCode" AS commodity_hs, "partnerCode" AS destination_m49, "reporterCode" AS origin_m49, period,
                  coalesce(sum("netWgt"), 0.0) AS kg FROM trade WHERE "flowCode" = 'X' GROUP BY 1, 2, 3, 4) x
USING (commodity_hs, destination_m49, origin_m49, period)""",
    "trade_years": """
SELECT period, lag(period) OVER (ORDER BY period) AS previous FROM (SELECT DISTINCT period FROM trade)""",
    "last_year": "SELECT max(period) AS last_period FROM trade",
    "shifts": """
SELECT c.commodity_hs, c.destination_m49, c.period, c.hhi AS hhi_current, q.hhi AS hhi_previous, c.hhi - q.hhi AS delta_hhi
FROM import_sums c JOIN trade_years y ON y.period = c.period LEFT JOIN import_sums q
ON q.commodity_hs = c.commodity_hs AND q.destination_m49 = c.destination_m49 AND q.period = y.previous""",
    "share": """
SELECT *, CASE WHEN total_imports_kg > 0 THEN bilateral_import_kg / total_imports_kg END AS ocs FROM lanes""",
    "share_shift": """
SELECT c.commodity_hs, c.destination_m49, c.origin_m49, c.period, c.ocs, q.ocs AS ocs_previous, c.ocs - q.ocs AS delta_ocs
FROM share c JOIN trade_years y ON y.period = c.period LEFT JOIN share q
ON q.commodity_hs = c.commodity_hs AND q.destination_m49 = c.destination_m49 AND q.origin_m49 = c.origin_m49
AND q.period = y.previous""",
    "anomalies": """
SELECT m.commodity_hs, m.destination_m49, m.origin_m49, m.period, m.mtd, u.unit_value, u.z_uv, s.delta_hhi
FROM mirror m JOIN last_year ON m.period = last_period
LEFT JOIN uv u USING (commodity_hs, destination_m49, origin_m49, period)
LEFT JOIN shifts s ON s.commodity_hs = m.commodity_hs AND s.destination_m49 = m.destination_m49 AND s.period = m.period""",
    # ------------------------------------------------------ enriched and scored
    "enriched": """
SELECT m.*, d.bilateral_import_kg, d.total_imports_kg, d.ds_prime, d.idr, d.ocs, d.bdi, d.ssr, d.hhi, d.sci, d.sci_half,
       d.dq_flag, a.mtd, a.unit_value, a.z_uv, a.delta_hhi, c.pcc, c.crs
FROM metrics m CROSS JOIN last_year y
LEFT JOIN dep d ON CAST(CAST(d.commodity_hs AS BIGINT) AS VARCHAR) = m.commodity_hs
  AND d.destination_m49 = m.destination_m49 AND d.origin_m49 = m.origin_m49 AND d.period = y.last_period
LEFT JOIN anomalies a ON CAST(CAST(a.commodity_hs AS BIGINT) AS VARCHAR) = m.commodity_hs
  AND a.destination_m49 = m.destination_m49 AND a.origin_m49 = m.origin_m49
LEFT JOIN crs_short c ON c.commodity_hs = m.commodity_hs
  AND c.country_m49 = m.destination_m49 AND c.period = y.last_period""",
    "tied": "SELECT *, md5(concat_ws('|', commodity_hs, destination_m49, origin_m49)) AS tie FROM enriched",
    "normed": """
SELECT *, CASE WHEN sci IS NULL THEN NULL WHEN n_sci > 1 THEN r_sci / (n_sci - 1) ELSE 1.0 END AS sci_norm,
       CASE WHEN his IS NULL THEN NULL WHEN n_his > 1 THEN r_his / (n_his - 1) ELSE 1.0 END AS his_norm,
       CASE WHEN crs IS NULL THEN NULL WHEN n_crs > 1 THEN r_crs / (n_crs - 1) ELSE 1.0 END AS crs_norm FROM (
  SELECT *, count(sci) OVER () AS n_sci, count(his) OVER () AS n_his, count(crs) OVER () AS n_crs,
         CAST(row_number() OVER (ORDER BY stable(sci) NULLS LAST, tie) - 1 AS DOUBLE) AS r_sci,
         CAST(row_number() OVER (ORDER BY stable(ln(1 + his)) NULLS LAST, tie) - 1 AS DOUBLE) AS r_his,
         CAST(row_number() OVER (ORDER BY stable(crs) NULLS LAST, tie) - 1 AS DOUBLE) AS r_crs FROM tied)""",
    "scored": """
SELECT *, CASE WHEN sci_norm IS NOT NULL AND crs_norm IS NOT NULL AND his_norm IS NOT NULL
               THEN sci_norm * crs_norm * (1 + his_norm) / 4.0 END AS cvs, his_norm AS cvs_hazard_only,
       concat_ws(';', CASE WHEN sci_norm IS NULL THEN 'sci_norm' END, CASE WHEN crs_norm IS NULL THEN 'crs_norm' END,
                 CASE WHEN his_norm IS NULL THEN 'his_norm' END) AS cvs_missing_inputs
FROM normed""",
    "pairs": """
SELECT r.row_id, t.pos, r.reference, trim(r.origin) AS from_country, o.m49 AS from_code, t.name AS to_country,
       d.m49 AS to_code,
       CASE WHEN r.hs_code IS NOT NULL THEN c.commodity_hs END AS hs_code, r.commodities AS commodity
FROM raw r JOIN cleaned c USING (row_id) JOIN pieces t ON t.row_id = r.row_id AND t.role = 'followUp' AND t.name <> ''
LEFT JOIN name_map o ON o.name = trim(r.origin) LEFT JOIN name_map d ON d.name = t.name
WHERE r.origin IS NOT NULL AND r.origin <> ''""",
    "pair_codes": """
SELECT arg_min(from_country, row_id * 100 + pos) AS from_country, from_code,
       arg_min(to_country, row_id * 100 + pos) AS to_country, to_code,
       list_sort(list(DISTINCT hs_code)) AS codes, count(DISTINCT hs_code) AS hs_code_count
FROM pairs WHERE from_code IS NOT NULL AND to_code IS NOT NULL AND hs_code <> '' AND from_code <> to_code
GROUP BY from_code, to_code""",
}
